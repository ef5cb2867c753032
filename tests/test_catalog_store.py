"""Row numbers, one sequence of batches, stores, indexes, file effects, zones, embedded tags and rounds of descriptions."""

import glob
import json
import os
import random
import struct
import time
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquery.operators import catalog, describe, gallery, ingest, lexical_index, order, ranking, vector_index, zones
from vistaquery.operators.ingest import PackLimits, pack
from vistaquery.plans.query import QuerySpec, specify
from vistaquery.sources import effects, embedded, shared, views
from vistaquery.sources.store import BucketedStore


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_numbered(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 2, 2, 3]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    got = order.numbered(df, [F.col("v").desc_nulls_last(), F.col("k").asc()], by=("g",)).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == [r[2] for r in own]
        assert sorted(r.position for r in got if r.g == g) == list(range(1, len(own) + 1))
    whole = order.numbered(df, [F.col("v").asc()], first=0)
    assert sorted(r.position for r in whole.collect()) == list(range(500))
    assert [r.v for r in sorted(whole.collect(), key=lambda r: r.position)] == sorted((r[1] for r in rows), key=lambda v: (v is not None, v or 0))
    assert "SinglePartition" not in plan_of(order.numbered(df, [F.col("v").asc()], by=("g",)))
    assert order.numbered(df.limit(0), [F.col("v").asc()]).count() == 0


@pytest.mark.parametrize(("block", "fan", "count"), [(50_000, 1000, 10), (7, 4, 5), (16, 5, 1)])
def test_pack_sequence_equals_the_sequential_rule(spark, block, fan, count):
    rnd = random.Random(block)
    items = [(f"e{k}", k, rnd.random() > 0.1, rnd.choice([0, 10, 40, 60, 90, 101, 200])) for k in range(331)]
    limits = PackLimits(count=count, bytes=200, base=20)
    want = list(pack([(p, b) for _, _, p, b in items], limits))
    rnd.shuffle(items)
    df = spark.createDataFrame(items, "entry_id string, position long, prepared boolean, bytes long").repartition(5)
    got = sorted(ingest.pack_sequence(df, limits, block, fan).collect(), key=lambda r: r.position)
    assert [(r.batch_no, r.outcome) for r in got] == want


def test_pack_sequence_of_nulls_and_none(spark):
    df = spark.createDataFrame([("b", 1, None, 5), ("a", 1, True, None), ("c", None, True, 5)], "entry_id string, position long, prepared boolean, bytes long")
    got = [(r.entry_id, r.batch_no, r.outcome) for r in ingest.pack_sequence(df, PackLimits(3, 100, 0)).orderBy("batch_no", "entry_id").collect()]
    assert got == [("a", 1, "packed"), ("c", 1, "packed"), ("b", 2, "unprepared")]
    assert ingest.pack_sequence(df.limit(0), PackLimits(3, 100, 0)).count() == 0


def test_parse_responses_by_kind(spark):
    rows = [
        (1, '[{"entry_id": "a", "description": "{not an object"}]'), (2, '{"a": {"content": {}}, "b": 3}'), (3, '{"results": {"a": null}}'), (4, '[{"entry_id": "a", "content": "{x", "context": null}]'),
        (5, '[{"entry_id": "a", "description": null, "content": 1}]'), (6, "{"), (7, None), (8, '"a"'), (9, '[{"entry_id": 5, "description": {}}, ["a"], {"entry_id": "a", "description": {"z": 1}}, {"entry_id": "a", "description": {"z": 2}}]'),
        (10, '{"results": [{"entry_id": "b", "description": {}}]}'), (11, '{"results": null, "a": {}}'), (12, "[]"), (13, "null"),
    ]
    expected = spark.createDataFrame([(k, e) for k in range(1, 14) for e in ("a", "5", "b")], "batch_no int, entry_id string")
    got = {(r.batch_no, r.entry_id): json.loads(r.description) for r in ingest.parse_responses(spark.createDataFrame(rows, "batch_no int, text string"), expected).collect()}
    assert got == {(2, "a"): {"content": {}}, (4, "a"): {"content": "{x", "context": None}, (9, "a"): {"z": 1}, (10, "b"): {}}


def file_times(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_store_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(2000).select(F.concat(F.lit("e"), "id").alias("entry_id"), F.col("id").alias("v"), F.lit("old").alias("w"))
    store = BucketedStore(spark, path, rows.schema, buckets=60)
    store.create(rows)
    before = file_times(path)
    time.sleep(0.05)
    new = spark.createDataFrame([(f"e{k}", f"new{k}") for k in (3, 77, 1500, 1501, 9999)], "entry_id string, w string")
    touched = store.upsert(new)
    after = file_times(path)
    changed = {os.path.basename(os.path.dirname(f)) for f in before.keys() ^ after.keys()} | {os.path.basename(os.path.dirname(f)) for f in before.keys() & after.keys() if before[f] != after[f]}
    assert 0 < len(touched) <= 5 and changed <= {f"bucket={b}" for b in touched}
    got = {r.entry_id: (r.v, r.w) for r in store.read().collect()}
    assert len(got) == 2001 and got["e3"] == (3, "new3") and got["e4"] == (4, "old") and got["e9999"] == (None, "new9999")
    found = store.lookup(spark.createDataFrame([("e77",), ("nobody",)], "entry_id string"))
    assert [r.w for r in found.collect()] == ["new77"]
    assert "PartitionFilters: [" in plan_of(found) and "bucket" in plan_of(found).split("PartitionFilters: [")[1].split("]")[0]
    assert store.upsert(new.limit(0)) == []


def test_store_deletes_by_prefix_and_empties_buckets(spark, tmp_path):
    long = "x" * catalog.ENTRY_ID_LENGTH
    rows = spark.createDataFrame([(long, 1), (f"{long}_item_1", 2), (f"{long}y", 3), ("short", 4), ("short_item", 5)], "item_id string, v int")
    store = BucketedStore(spark, str(tmp_path / "s"), rows.schema, ("item_id",), buckets=50)
    store.create(rows)
    store.delete(spark.createDataFrame([(long,), ("short",)], "entry_id string"))
    assert sorted(r.v for r in store.read().collect()) == [3, 5]
    store.delete(spark.createDataFrame([(f"{long}",), ("short_item",), ("nobody",)], "entry_id string"))
    assert [r.v for r in store.read().collect()] == [3]


def test_lexical_index_reads_only_the_buckets_of_its_tokens(spark, sf):
    docs = views.collection_docs(spark, sf)
    index = lexical_index.build_lexical_index(docs, buckets=16)
    specs = specify(["er re an", "die der", "of the"])
    found = index.candidates(specs)
    want = ranking.lexical_candidates(docs, specs)
    key = lambda df: sorted(map(tuple, df.select("collection", "entry_id", "query_id", "score").collect()))
    assert key(found) == key(want) and key(found)
    tokens = sorted({t for q in specs for t in q.tokens})
    files = {f.split("bucket=")[1].split("/")[0] for f in index.postings_of(tokens).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files <= {str(b) for b in index.buckets_of(tokens)} and len(index.buckets_of(tokens)) <= len(tokens)
    text = plan_of(index.postings_of(tokens))
    assert "PartitionFilters: [bucket" in text and "PushedFilters: [In(token" in text
    assert "CartesianProduct" not in plan_of(found) and index.candidates(specify(["of the"])).count() == 0


def test_lexical_candidates_repeat_tokens(spark):
    docs = spark.createDataFrame([("c", "1", ["aa", "bb", "aa"], "aa bb aa"), ("c", "2", None, ""), ("c", "3", ["zz"], "zz"), ("c", "4", ["bb", "aa"], "bb aa")], "collection string, entry_id string, tokens array<string>, token_string string")
    got = sorted((r.entry_id, r.query_id, r.score) for r in ranking.lexical_candidates(docs, specify(["aa bb aa", "bb", "none"])).collect())
    assert got == [("1", "aa bb aa", 4), ("1", "bb", 3), ("4", "aa bb aa", 2), ("4", "bb", 3)]


def test_vector_index(spark):
    rnd = np.random.Generator(np.random.PCG64(2))
    middles = rnd.standard_normal((30, 16))
    rows = [("c", f"e{k}", [float(x) for x in middles[k % 30] + 0.3 * rnd.standard_normal(16)]) for k in range(3000)]
    rows += [("c", "null", None), ("c", "zero", [0.0] * 16), ("c", "nan", [float("nan")] * 16), ("c", "other", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "collection string, entry_id string, embedding array<double>")
    index = vector_index.build_vector_index(vectors, per_list=100)
    queries = [QuerySpec(f"q{k}", "", "", ("t",), (), tuple(float(x) for x in middles[k] + 0.3 * rnd.standard_normal(16))) for k in range(8)]
    of = lambda df: {(r.query_id, r.entry_id) for r in df.collect()}
    want = of(ranking.semantic_rank(vectors.where("entry_id like 'e%'"), queries, 2))
    got = of(index.rank(queries, 2, probes=4))
    assert len(got & want) >= 0.9 * len(want) and of(index.rank(queries, 2, exact=True)) == want
    scan = index.scan(queries[:1], probes=2)
    assert 0 < scan.count() < 1500 and "PartitionFilters: [isnotnull(list" in plan_of(scan) or "list" in plan_of(scan).split("PartitionFilters: [")[1].split("]")[0]
    empty = vector_index.build_vector_index(vectors.limit(0))
    assert empty.rank(queries, 2).count() == 0


def uploads(spark, rows):
    return spark.createDataFrame(rows, "position int, name string, payload binary")


def entries(spark, rows):
    return spark.createDataFrame([(i, (h, p, "n")) for i, h, p in rows], "entry_id string, metadata struct<file_hash:string,file_path:string,file_name:string>")


def all_files(root):
    return sorted(os.path.relpath(f, root) for f in glob.glob(f"{root}/**", recursive=True, include_hidden=True) if os.path.isfile(f))


def sha(b):
    import hashlib

    return hashlib.sha256(b).hexdigest()


def test_store_uploads_once(spark, tmp_path):
    root, there = str(tmp_path / "up"), f"{tmp_path}/old/x.png"
    known = entries(spark, [("e1", sha(b"known"), there)])
    rows = uploads(spark, [(2, "b.JPG", b"one"), (1, "dir\\a.jpg", b"one"), (3, "c", b"two"), (4, "k.png", b"known"), (5, "empty", b""), (6, "null", None)]).repartition(3)
    got = {r.file_hash: (r.name, r.path, r.new) for r in effects.store_uploads(rows, known, root, datetime(2024, 5, 6)).collect()}
    one, two = f"20240506/{sha(b'one')}.jpg", f"20240506/{sha(b'two')}"
    assert got == {sha(b"one"): ("dir\\a.jpg", f"{root}/{one}", True), sha(b"two"): ("c", f"{root}/{two}", True), sha(b"known"): ("k.png", there, False)}
    assert all_files(root) == sorted([one, two])
    effects.store_uploads(rows, known, root, datetime(2024, 5, 6))  # once more: the same files
    assert all_files(root) == sorted([one, two])


def test_failed_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "up")
    rows = spark.createDataFrame([(f"{root}/d/{k}", b"x") for k in range(20)] + [("/outside/it", b"x")], "path string, payload binary").repartition(4)
    with pytest.raises(Exception, match="is not below"):
        effects.apply_effects(rows, root)
    assert [f for f in all_files(root) if not f.startswith(".pending")] == []  # a task may outlive the job
    with pytest.raises(Exception, match="is not below"):
        effects.apply_effects(spark.createDataFrame([(f"{root}/../y", b"x")], "path string, payload binary"), root)


def test_files_of_lost_attempts_are_not_kept(tmp_path):
    from pyspark.sql import Row

    writer = effects.FileEffectsWriter(str(tmp_path))
    rows = [Row(path=f"{tmp_path}/a/{k}", payload=bytearray([k])) for k in range(3)]
    writer.write(iter(rows))  # this attempt is lost
    done = writer.write(iter(rows))
    writer.commit([done, None])
    assert all_files(tmp_path) == ["a/0", "a/1", "a/2"] and (tmp_path / "a/1").read_bytes() == b"\1"
    gone = effects.FileEffectsWriter(str(tmp_path))
    message = gone.write(iter([Row(path=f"{tmp_path}/a/{k}", payload=None) for k in (0, 1, 2, 9)]))
    assert len(all_files(tmp_path)) == 4  # nothing goes before the commit, and the list is there
    gone.commit([message])
    assert all_files(tmp_path) == [] and not (tmp_path / "a").exists() and tmp_path.exists()
    lost = effects.FileEffectsWriter(str(tmp_path))
    lost.write(iter(rows))
    lost.abort([None])
    assert all_files(tmp_path) == []


def test_delete_uploads(spark, tmp_path):
    root = str(tmp_path / "up")
    effects.apply_effects(spark.createDataFrame([(f"{root}/d/{k}", k.encode()) for k in "abc"], "path string, payload binary"), root)
    (tmp_path / "elsewhere").write_bytes(b"x")
    rows = entries(spark, [("e1", "h1", f"{root}/d/a"), ("e2", "h1", f"{tmp_path}/elsewhere"), ("e3", "h2", f"{root}/d/b")])
    held = BucketedStore(spark, str(tmp_path / "entries"), rows.schema, buckets=8)
    held.create(rows)
    items = spark.createDataFrame([("e1_x",), ("e1",), ("e3",)], "item_id string")
    kept = BucketedStore(spark, str(tmp_path / "items"), items.schema, ("item_id",), buckets=8)
    kept.create(items)
    gone = effects.delete_uploads(spark.createDataFrame([("h1",), ("h9",)], "file_hash string"), held, kept, root).collect()
    assert [(r.file_hash, r.ids) for r in gone] == [("h1", ["e1", "e2"])]
    assert [r.entry_id for r in held.read().collect()] == ["e3"] and sorted(r.item_id for r in kept.read().collect()) == ["e1_x", "e3"]
    assert all_files(root) == ["d/b", "d/c"] and (tmp_path / "elsewhere").exists()


def test_zones(spark):
    assert [round(r[0], 6) if r[0] is not None else None for r in spark.createDataFrame(
        [(["10", "30", "36"], "s"), (["10", "30", "36"], "N"), (["10", "30"], "N"), (None, "N"), (["1", "2", "x"], "N"), (["1", "2", "3"], None)], "d array<string>, r string"
    ).select(zones.degrees(F.col("d"), F.col("r"), "S")).collect()] == [-10.51, 10.51, None, None, None, None]
    rnd = random.Random(4)
    ring = [(0.5, 0.5), (9.5, 1.0), (5.0, 4.0), (9.0, 9.0), (1.0, 7.0)]  # not convex
    rings = spark.createDataFrame([("Europe/Paris", ring), ("Asia/Tokyo", [(x + 0.0, y - 20.0) for x, y in ring] + [(0.5, -19.5)]), ("Bad/One", ring[:2])], "zone string, ring array<struct<lon:double,lat:double>>")
    points = [(k, rnd.uniform(-1, 11), rnd.uniform(-21, 11)) for k in range(400)] + [(500, None, 1.0)]

    def inside(x, y, dy):
        hit, shape = False, [(a, b + dy) for a, b in ring]
        for (x1, y1), (x2, y2) in zip(shape, shape[1:] + shape[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    got = {r.point_id: r.zone for r in zones.zone_of(spark.createDataFrame(points, "point_id long, lon double, lat double"), rings).collect()}
    assert got == {k: None if x is None else "Europe/Paris" if inside(x, y, 0) else "Asia/Tokyo" if inside(x, y, -20) else None for k, x, y in points}
    assert {"Europe/Paris", "Asia/Tokyo", None} == set(got.values())
    times = spark.createDataFrame([("2024-07-01 12:00:00.5", "Europe/Paris"), ("2024-01-01 12:00:00", "Europe/Paris"), ("2024-01-01 01:00:00", "America/New_York"), ("2024-01-01 12:00:00", None)], "t string, z string")
    assert [r[0] for r in times.select(zones.local_time(F.to_timestamp("t"), F.col("z"))).collect()] == ["2024-07-01T14:00:00.500000+02:00", "2024-01-01T13:00:00+01:00", "2023-12-31T20:00:00-05:00", "2024-01-01T12:00:00+00:00"]


def tiff(order, image, exif, gps):
    """A TIFF block of text, rational and short tags."""
    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", 8)

    def directory(tags, at):
        body, data, after = struct.pack(f"{order}H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
        for tag, value in sorted(tags.items()):
            if isinstance(value, str):
                kind, count, raw = 2, len(value) + 1, value.encode() + b"\0"
            elif isinstance(value, list):
                kind, count, raw = 5, len(value), b"".join(struct.pack(f"{order}II", *x) for x in value)
            elif isinstance(value, bytes):
                kind, count, raw = 1, len(value), value
            else:
                kind, count, raw = (4, 1, struct.pack(f"{order}I", value)) if value > 65535 or tag in (0x8769, 0x8825) else (3, 1, struct.pack(f"{order}H", value) + b"\0\0")
            if len(raw) > 4:
                place, data = struct.pack(f"{order}I", after + len(data)), data + raw
            else:
                place = raw.ljust(4, b"\0")
            body += struct.pack(f"{order}HHI", tag, kind, count) + place
        return body + b"\0\0\0\0" + data

    first = directory(image | {0x8769: 0, 0x8825: 0}, 8)
    second = directory(exif, 8 + len(first))
    first = directory(image | {0x8769: 8 + len(first), 0x8825: 8 + len(first) + len(second)}, 8)
    return head + first + second + directory(gps, 8 + len(first) + len(second))


def png(chunks):
    body = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + b"".join(body(k, b) for k, b in [(b"IHDR", bytes(13)), *chunks, (b"IEND", b"")])


def jpeg(segments):
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", len(s) + 2) + s for s in segments) + b"\xff\xda\0\2picture\xff\xd9"


XMP = b'<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:RDF><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:CreateDate="2019-05-06T07:08:09+01:00" dc:creator="Xavier"><xmp:ModifyDate>2020-01-01T00:00:00</xmp:ModifyDate><dc:rights> all </dc:rights><dc:description><rdf:Alt><rdf:li xml:lang="x">not taken</rdf:li></rdf:Alt></dc:description></rdf:Description></rdf:RDF></x:xmpmeta>'


@pytest.mark.parametrize("byte_order", ["<", ">"])
def test_embedded_metadata(spark, byte_order):
    image = {0x010F: "Maker", 0x0132: "2001:01:01 00:00:00", 0x013B: "Artist of EXIF", 0x0112: 6, 0x011A: [(72, 1)], 0x9C9B: "títle".encode("utf-16le"), 0x0100: 99}
    exif = {0x9003: "2021:02:03 04:05:06", 0x9011: "+02:00", 0x9291: "25", 0x9004: "garbage", 0x829D: [(28, 10)], 0x920A: [(1, 0)]}
    gps = {1: "N", 2: [(5, 1), (30, 1), (0, 1)], 3: "E", 4: [(1, 1), (0, 1), (36, 1)], 7: [(10, 1), (20, 1), (305, 10)], 0x1D: "2021:02:03"}
    block = tiff(byte_order, image, exif, gps)
    text = lambda k, v: (b"tEXt", k + b"\0" + v)
    files = {
        "jpg": ("jpg", jpeg([b"Exif\0\0" + block, b"http://ns.adobe.com/xap/1.0/\0" + XMP])),
        "png": ("png", png([text(b"Author", b"First"), text(b"AUTHOR ", b" P\xe9ter "), (b"zTXt", b"Comment\0\0" + zlib.compress(b"squeezed")), (b"iTXt", b"Description\0\0\0en\0\0" + "übersetzt".encode()), text(b"Creation Time", b"2022:03:04 05:06:07"), text(b"date:create", b"2000-01-01T00:00:00+00:00"), (b"eXIf", block)])),
        "xmp": ("png", png([(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP), text(b"modify time", b"never")])),
        "cut": ("jpeg", jpeg([b"Exif\0\0" + block])[:60]), "short": ("png", b"\x89PNG"), "none": ("jpg", None), "bad": ("jpg", jpeg([b"http://ns.adobe.com/xap/1.0/\0<a><b>", b"http://ns.adobe.com/xap/1.0/\0<!DOCTYPE x><a/>"])), "txt": ("txt", b"text"),
    }
    rows = spark.createDataFrame([(h, f"{h}.{e}", e, c) for h, (e, c) in files.items()], "file_hash string, file_name string, ext string, content binary")
    paris = spark.createDataFrame([("Europe/Paris", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)])], "zone string, ring array<struct<lon:double,lat:double>>")
    got = {r.file_hash: r for r in embedded.embedded_metadata(rows, paris).collect()}
    assert set(got) == set(files) - {"txt"}
    own = lambda h, e, m: {"Filename": f"{h}.{e}", "Ext": e, "MimeType": m}
    exif_tags = {"Make": "Maker", "DateTime": "2001:01:01 00:00:00", "Artist": "Artist of EXIF", "Orientation": "6", "XResolution": "72.0", "XPTitle": "títle"}
    assert got["jpg"].tags == own("jpg", "jpg", "image/jpeg") | exif_tags | {"Copyright": "all"}
    assert got["jpg"].exif["FNumber"] == "2.8" and "FocalLength" not in got["jpg"].exif and json.loads(got["jpg"].gps["GPSLatitude"]) == [5, 30, 0]
    assert got["jpg"].date_items == {"DateTimeOriginal": "2021-02-03T04:05:06.25+02:00", "GPSDateStamp": "2021-02-03T11:20:30.500000+01:00", "DateTime": "2020-01-01T00:00:00+00:00"}
    assert got["png"].tags == own("png", "png", "image/png") | exif_tags | {"Artist": "Péter", "UserComment": "squeezed", "ImageDescription": "übersetzt"}
    assert got["png"].date_items == {"DateTimeOriginal": "2022-03-04T05:06:07+00:00"}
    assert got["xmp"].tags == own("xmp", "png", "image/png") | {"Artist": "Xavier", "Copyright": "all"}
    assert got["xmp"].date_items == {"DateTimeOriginal": "2019-05-06T07:08:09+01:00", "DateTime": "2020-01-01T00:00:00+00:00"}
    for h in ("cut", "short", "none", "bad"):  # of the one cut off a short value can be read
        assert set(got[h].tags) - ({"Orientation"} if h == "cut" else set()) == {"Filename", "Ext", "MimeType"} and got[h].date_items == {}
    plain = {r.file_hash: r for r in embedded.embedded_metadata(rows).collect()}
    assert plain["jpg"].date_items["GPSDateStamp"] == "2021-02-03T10:20:30.500000+00:00"


def test_damaged_files_never_fail():
    whole = [jpeg([b"Exif\0\0" + tiff("<", {0x010F: "M" * 9}, {0x9003: "x" * 9}, {2: [(1, 1)] * 3}), b"http://ns.adobe.com/xap/1.0/\0" + XMP]), png([(b"zTXt", b"Comment\0\0" + zlib.compress(b"c")), (b"eXIf", tiff(">", {0x010F: "M" * 9}, {}, {}))])]
    rnd = random.Random(3)
    for content in whole:
        for _ in range(1500):
            b = bytearray(content)
            for _ in range(rnd.randint(1, 4)):
                b[rnd.randrange(len(b))] = rnd.randrange(256)
            embedded.read_raw(bytes(b[: rnd.randint(0, len(b))] if rnd.random() < 0.3 else b))


CALLS = "calls"


def make_call(folder, limited=(), broken=()):
    def call(pdf):
        number = int(pdf["batch_no"].iloc[0])
        with open(f"{folder}/{number}-{time.time_ns()}", "w"):
            pass
        if number in limited:
            raise describe.RateLimited
        if number in broken:
            raise ValueError(f"broken {number}")
        return json.dumps([{"entry_id": e, "description": {"content": {"e": e}, "context": {}}} for e in pdf["entry_id"] if not e.endswith("7")])

    return call


def test_describe_rounds(spark, tmp_path):
    items = spark.createDataFrame([(f"e{k}", k, k % 11 != 5, 10 if k % 13 else 500) for k in range(120)], "entry_id string, position long, prepared boolean, bytes long")
    batches = shared.written(ingest.pack_sequence(items, PackLimits(count=4, bytes=100, base=0)), "batches")
    calls = tmp_path / "calls"
    calls.mkdir()
    run = lambda **more: {r.entry_id: (r.status, r.reason, r.description) for r in describe.describe_rounds(batches, make_call(str(calls), limited=(30, 33), broken=(2,)), f"{tmp_path}/rounds", per_round=6, **more).collect()}
    sent = lambda: sorted(int(f.split("-")[0]) for f in os.listdir(calls))
    first = run(stop_after=2)
    assert {s for s, _, _ in first.values()} == {"described", "failed", None} and max(sent()) <= 12
    packed = {r.batch_no for r in batches.where("outcome = 'packed'").collect()}
    got, before = run(), sent()
    assert before == sorted(b for b in packed if b <= 30) and len(before) == len(set(before))  # the round of 30 is the last; nothing twice
    assert run() == got and sent() == before  # all rounds are there: no call
    for r in batches.collect():
        status, reason, description = got[r.entry_id]
        if r.batch_no >= 30:
            assert (status, reason, description) == ("rate_limited", describe.LIMITED, None)
        elif r.outcome != "packed":
            assert (status, reason) == ("failed", describe.REASONS[r.outcome])
        elif r.batch_no == 2:
            assert (status, reason) == ("failed", "broken 2")
        elif r.entry_id.endswith("7"):
            assert (status, reason) == ("failed", describe.NOTHING)
        else:
            assert (status, reason) == ("described", "") and json.loads(description)["content"]["e"] == r.entry_id


def test_pending_list_has_no_single_task(spark, sf):
    entries = views.nested(views.unique_entries(spark, sf))
    listed = gallery.pending_listed(entries)
    rows = sorted(listed.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, len(rows) + 1)) and [(r.uploaded_at, r.entry_id) for r in rows] == sorted((r.uploaded_at, r.entry_id) for r in rows)


def test_bounds_of_a_column_of_masks(spark):
    from vistaquery.functions import masks

    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("0123456789XXXX") for _ in range(n))
    some = [f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}" for _ in range(600)] + ["2023-02-3XTXX:XX:XX", "2024-02-xxTXX:XX:XX", "XXXX-XX-XXTXX:XX:XX", "2021-5-1", "", None]
    want = {}
    for m in some:
        try:
            want[m] = tuple(x.timestamp() for x in masks.bounds(m)) if m is not None else (None, None)
        except ValueError:
            want[m] = (None, None)
    first, last = masks.bounds_columns(F.col("m"))
    got = {r.m: (r.a, r.b) for r in spark.createDataFrame([(m,) for m in some], "m string").select("m", first.alias("a"), last.alias("b")).collect()}
    assert got == want and sum(a is not None for a, _ in want.values()) > 20


def test_prompt_sections(tmp_path):
    from vistaquery.plans import config

    (tmp_path / "admin.md").write_text("up to __batch_size__ items, __other__")
    (tmp_path / "item.md").write_text("one")
    assert config.prompt_sections(str(tmp_path), 20) == {"admin": "up to 20 items, __other__", "item": "one"}
    assert config.history_user({}) == "local" and config.history_user({"MEDIA_SEARCH_HISTORY_USER": "me"}) == "me"


def test_history_label_and_normalized(spark):
    rows = spark.createDataFrame([("2024-05-06T07:08:09+00:00", "cats", ["a", "b"]), ("2024-05-06T07:08:09+00:00", "", []), (None, None, None)], "t string, q string, ids array<string>")
    got = [r[0] for r in rows.select(gallery.history_label(F.col("t"), F.col("q"), F.col("ids"))).collect()]
    assert got == ["2024-05-06 07:08 · cats · 2 result(s)", "2024-05-06 07:08 · Untitled search · 0 result(s)", " · Untitled search · 0 result(s)"]
    times = spark.range(1).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-05-06 07:08:09.5'").alias("created_at"))
    assert tuple(gallery.normalized_history(times).first()) == ("0", "2024-05-06T07:08:09+00:00")
    assert gallery.normalized_history(times.withColumn("created_at", F.lit("as it is"))).first().created_at == "as it is"


def test_mime_and_epochs(spark):
    from vistaquery.functions import dates, media

    rows = spark.createDataFrame([("jpg", "image"), ("avi", "video"), ("pdf", ""), ("odd", "video"), ("odd", ""), ("", "image"), (None, "")], "e string, k string")
    assert [r[0] for r in rows.select(media.mime_type(F.col("e"), F.col("k"))).collect()] == ["image/jpeg", "video/x-msvideo", "application/pdf", "video/odd", "", "", ""]
    assert [r[0] for r in rows.select(media.compatible(F.col("e"))).collect()] == [True, True, False, False, False, False, False]
    epochs = spark.createDataFrame([(1714979289.5,), (1714979289.0,), (0.0,), (4e10,), (None,)], "s double")
    assert [r[0] for r in epochs.select(dates.format_epoch(F.col("s"))).collect()] == ["2024-05-06T07:08:09.500000+00:00", "2024-05-06T07:08:09+00:00", None, None, None]
