"""What keeps work in proportion to the input: narrow shuffles, rounds that grow, inputs that are read once."""

import json
import os

import pytest
from pyspark.sql import functions as F

import vistaquery.plans.catalog_queries  # noqa: F401  registers more
from vistaquery.functions import masks
from vistaquery.operators import catalog, describe, gallery, ingest, lexical_index, ranking, vector_index
from vistaquery.operators.ingest import PackLimits
from vistaquery.plans.queries import QUERIES
from vistaquery.plans.query import specify
from vistaquery.sources import effects, scan, shared, store, views
from vistaquery.sources.store import BucketedStore


def nodes(df, kind):
    """The output columns of the optimized plan's nodes of a kind."""
    plan, out, k = df._jdf.queryExecution().optimizedPlan(), [], 0
    while (node := plan.apply(k)) is not None:
        if node.nodeName() == kind:
            out.append(node.output().toString())
        k += 1
    return out


def exchanged(df):
    """The output columns of what the physical plan shuffles."""
    plan, out, k = df._jdf.queryExecution().executedPlan().initialPlan(), [], 0
    while (node := plan.apply(k)) is not None:
        if node.nodeName() == "Exchange":
            out.append(node.output().toString())
        k += 1
    return out


def test_rounds_grow_with_the_list(spark, tmp_path):
    for batches, first in ((1, 13), (13, 13), (14, 13), (1000, 13), (1_000_000, 13), (10**9, 1)):
        ends = describe.round_ends(batches, first)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sizes[0] == first and ends[-1] >= batches and len(ends) < 70 and all(b <= 2 * a for a, b in zip(sizes, sizes[1:]))
    items = spark.createDataFrame([(f"e{k}", k, True, 10) for k in range(40)], "entry_id string, position long, prepared boolean, bytes long")
    batches = shared.written(ingest.pack_sequence(items, PackLimits(count=1, bytes=100, base=0)), "batches")
    call = lambda pdf: json.dumps([{"entry_id": e, "description": {"content": {}, "context": {}}} for e in pdf["entry_id"]])
    out = describe.describe_rounds(batches, call, str(tmp_path), count=describe.FLUSH // 8)  # a first round of 8 batches
    assert out.where("status = 'described'").count() == 40 and len(os.listdir(tmp_path)) == 5


@pytest.mark.parametrize("columns", [["input_pos", "file_hash", "text_bytes", "line1", "line2"], ["entry_id", "master_date"]])
def test_no_text_goes_through_the_joins(spark, sf, columns):
    for rows in (views.flat_entries(spark, sf), views.unique_entries(spark, sf)):
        joined = nodes(rows.select(*columns), "Join")
        assert len(joined) == 3 and not any("text#" in x for x in joined)
    assert len(nodes(views.whole_entries(spark, sf), "Join")) == 4 and not any("text#" in x for x in nodes(views.whole_entries(spark, sf), "Join")[1:])


def test_lines_stay_with_their_texts(spark, sf):
    """Whole first and second lines went through the joins beside the texts, and where it only mattered whether they are blank."""
    whole = views.whole_entries(spark, sf)
    assert not any(x in rows for rows in nodes(whole, "Join") for x in ("line1#", "line2#"))
    want = {r.input_pos: (r.line1, r.line2) for r in views.unique_entries(spark, sf).select("input_pos", "line1", "line2").collect()}
    assert {r.input_pos: (r.line1, r.line2) for r in whole.select("input_pos", "line1", "line2").collect()} == want
    short = views.documents(spark, sf, line1=F.substring(views.line(1), 1, 1))
    assert short.columns.count("line1") == 1 and max(len(r[0] or "") for r in short.select("line1").collect()) == 1


def test_a_change_leaves_no_rows_aside(spark, tmp_path):
    """Changed buckets are read back by bucket, from a folder that goes."""
    rows = spark.range(50).select(F.concat(F.lit("e"), "id").alias("entry_id"), F.col("id").alias("v"))
    store = BucketedStore(spark, str(tmp_path / "s"), rows.schema, buckets=4)
    store.create(rows)
    root = shared.shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    store.upsert(rows.limit(5).withColumn("v", F.lit(7).cast("long")))
    assert set(os.listdir(root)) == before and store.read().where("v = 7").count() in (5, 6)
    found = store.lookup(rows.select("entry_id"), (F.col("v") + 1).alias("w"))
    assert found.columns == ["entry_id", "w"] and found.count() == 50


def test_deletions_and_marks_deal_no_rows(spark, tmp_path, monkeypatch):
    """Rows were dealt once or twice, and written twice."""
    rows = spark.range(300).select(F.concat(F.lit("e"), "id").alias("entry_id"), F.struct(F.struct(F.lit(None).cast("string").alias("chroma_indexed_at")).alias("dates"), F.col("id").alias("v")).alias("metadata"))
    held = BucketedStore(spark, str(tmp_path / "s"), rows.schema, buckets=4)
    held.create(rows)
    wrote, write = [], BucketedStore._write
    monkeypatch.setattr(BucketedStore, "_write", lambda self, rows, mode: (wrote.append(rows), write(self, rows, mode)))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held.delete(rows.where("id % 3 = 0").select("entry_id"))
        held.mark_indexed(rows.where("id % 5 = 0").select("entry_id"), F.lit("now"))
        assert len(wrote) == 2 and not any("metadata#" in x for changed in wrote for x in exchanged(changed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert {r.metadata.v: r.metadata.dates.chroma_indexed_at for r in held.read().collect()} == {k: None if k % 5 else "now" for k in range(300) if k % 3}


def test_ids_are_sent_in_batches(spark, tmp_path, monkeypatch):
    """The rest meet their rows by shuffle; ids may be those of the store itself, of which some buckets are emptied."""
    monkeypatch.setattr(store, "IDS", 12)
    monkeypatch.setattr(store, "BATCHES", 2)
    assert store.batched({1: 5, 2: 7, 3: 12, 4: 1, 5: 13, 6: 12}) == ([[4, 1], [2]], [3, 6, 5])
    rows = spark.range(100).select(F.concat(F.lit("e"), "id").alias("entry_id"), F.col("id").alias("v"))
    held = BucketedStore(spark, str(tmp_path / "s"), rows.schema, buckets=20)
    held.create(rows)
    first = sorted(r[0] for r in held._read().select("bucket").distinct().collect())
    touched = held.delete(held._read().where(F.col("bucket").isin(first[:9]) | (F.col("v") % 7 == 0)).select("entry_id"))
    left = held._read().collect()
    assert set(first[:9]) <= set(touched) and not {r.bucket for r in left} & set(first[:9])
    again = BucketedStore(spark, str(tmp_path / "t"), rows.schema, buckets=20)
    again.create(rows)
    assert {r.v for r in left} == {r.v for r in again._read().collect() if r.bucket not in first[:9] and r.v % 7}
    assert not any(f"bucket={b}" in os.listdir(tmp_path / "s") for b in first[:9])


def test_vectors_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(300).select(F.lit("c").alias("collection"), F.concat(F.lit("e"), "id").alias("entry_id"), F.array(*(F.rand(k).cast("float") for k in range(4))).alias("embedding"))
    vector_index.build_vector_index(rows.mapInPandas(count, rows.schema), per_list=50)
    assert made.value == 300


def test_phrases_are_sought_once(spark, sf):
    rows = spark.createDataFrame([(1, "It's New Year's Eve, at noon: noon!"), (2, "noonday 70s_ x70s Fall"), (3, None), (4, "ünoon the\nfall")], "k long, text string")
    keys = ["fall", "noon", "new year's eve", "70s", "the"]
    got = {r.k: r.p for r in rows.select("k", masks.phrase_matches(F.col("text"), keys).alias("p")).collect()}
    assert got == {1: ["noon", "new year's eve"], 2: ["fall"], 3: [], 4: ["fall", "noon", "the"]}
    plan = QUERIES["semantic_phrase_match"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "RLIKE" not in plan


def test_words_are_split_by_a_known_class(spark, sf):
    """The same class written out took several times as long."""
    rows = spark.createDataFrame([(1, "NOON_ Noon"), (2, "\u212aNOON 70S"), (3, "THE\u00c9 (OF)\u2028DIE[")], "k long, text string")
    got = {r.k: r.p for r in rows.select("k", masks.phrase_matches(F.col("text"), ["noon", "70s", "the", "of", "die"]).alias("p")).collect()}
    assert got == {1: ["noon"], 2: ["70s"], 3: ["the", "of", "die"]}
    assert "[^0-9A-Za-z_]+" not in QUERIES["semantic_phrase_match"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_postings_hold_numbers(spark, sf):
    index = lexical_index.build_lexical_index(views.collection_docs(spark, sf), buckets=4)
    assert index.postings().columns == ["token", "doc", "bucket"]
    joined = nodes(index.candidates(specify(["er re an"])), "Join")
    assert joined and not any("token_string#" in x or "words#" in x for x in joined)


def test_texts_are_tokenized_once(spark, sf):
    plan = ranking.lexical_rank(views.collection_docs(spark, sf), specify(["die der"]), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1


def test_folders_are_made_once(tmp_path, monkeypatch):
    made = []

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def create_dir(self, path, **more):
            made.append(path)
            return self.fs.create_dir(path, **more)

    locate = effects._locate
    monkeypatch.setattr(effects, "_locate", lambda path: (Counting(locate(path)[0]), locate(path)[1]))
    writer = effects.FileEffectsWriter(str(tmp_path))

    class Row:
        def __init__(self, path, payload):
            self.path, self.payload = path, payload

    done = writer.write(iter([Row(f"{tmp_path}/d/{k}", b"%d" % k) for k in range(50)]))
    writer.commit([done])
    assert made.count(f"{tmp_path}/d") == 1 and (tmp_path / "d" / "49").read_bytes() == b"49" and os.listdir(tmp_path) == ["d"]


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Spark's own reader of files holds the status of each on the driver."""
    monkeypatch.setattr(scan, "NAMES", 3)
    monkeypatch.setattr(scan, "BYTES", 10)
    for folder in ("in", "in/d/e", "in/_hidden", "in/.pending-1", "in/_a=1"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for name in ("a.JPG", "sp ace%20é.png", "_x", "_x=1", ".y", "z._COPYING_", "_metadata"):
            (tmp_path / folder / name).write_bytes(f"{folder}{name}".encode())
    (tmp_path / "in/empty").write_bytes(b"")
    (tmp_path / "in/dangling").symlink_to(tmp_path / "nowhere")
    (tmp_path / "in/link").symlink_to(tmp_path / "in/a.JPG")
    root = str(tmp_path / "in")
    spark_own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = lambda df: sorted(df.collect(), key=lambda r: r.path)
    whole, hashed = scan.scan_folder(spark, root), scan.scan_folder(spark, root, content=False)
    assert whole.dtypes == spark_own.dtypes and rows(whole) == rows(spark_own) and len(rows(whole)) == 10
    told = scan.file_metadata(spark_own)
    assert rows(scan.file_metadata(whole)) == rows(told) == rows(scan.file_metadata(hashed).select(told.columns))
    assert not whole.inputFiles() and not hashed.inputFiles()
    (tmp_path / "none").mkdir()
    assert scan.scan_folder(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan.scan_folder(spark, str(tmp_path / "nowhere"))
    scan.remove_folder(spark, root)
    assert not os.path.exists(root)


@pytest.mark.parametrize("name", ["file_metadata_scan", "stored_uploads"])
def test_scanned_files_go_by_tasks(spark, sf, name, monkeypatch):
    """They stayed until the driver ended, which then listed them at once."""
    made, new = [], shared.new_folder
    monkeypatch.setattr("vistaquery.plans.catalog_queries.new_folder", lambda *a: made.append(new(*a)) or made[-1])
    assert QUERIES[name](spark, sf).count() and len(made) == 1 and not os.path.exists(made[0].removeprefix("file:").replace("//", "/"))


def test_lists_of_effects_are_followed_by_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(effects, "LINES", 7)
    held, follow = [], effects.FileEffectsWriter._follow
    monkeypatch.setattr(effects.FileEffectsWriter, "_follow", lambda self, fs, pool, todo: (held.append(len(todo)), follow(self, fs, pool, todo)))

    class Row:
        def __init__(self, path, payload):
            self.path, self.payload = path, payload

    paths = [f"{tmp_path}/d{k % 2}/{k}" for k in range(50)]
    writer = effects.FileEffectsWriter(str(tmp_path))
    writer.commit([writer.write(Row(p, p.encode()) for p in paths), writer.write(iter([]))])
    assert held == [7] * 7 + [1] and all(open(p).read() == p for p in paths) and sorted(os.listdir(tmp_path)) == ["d0", "d1"]
    gone = effects.FileEffectsWriter(str(tmp_path))
    gone.commit([gone.write(Row(p, None) for p in paths[:49])])
    assert os.listdir(tmp_path) == ["d1"] and os.listdir(tmp_path / "d1") == [os.path.basename(paths[49])]


def test_collection_get_takes_whole_rows_of_the_first_alone(spark):
    rows = spark.createDataFrame([(c, f"e{k:03}", f"text {k}") for c in "ab" for k in range(100)], "collection string, entry_id string, document string")
    ids = rows.select("entry_id").where("entry_id > 'e005'")
    found = catalog.collection_get(rows, ids, F.col("document") != "text 7", 3)
    assert sorted((r.collection, r.entry_id, r.document) for r in found.collect()) == [(c, f"e00{k}", f"text {k}") for c in "ab" for k in (6, 8, 9)]
    assert sum("document#" in x for x in nodes(found, "Join")) == 1


def test_no_text_of_these_is_dealt(spark, sf):
    """What these give of a text is made where it is read; their shuffles carried all texts."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views_of = {
            "prep_explode": views.unique_documents(spark, sf).select("entry_id", "lang", "source", "line2"),
            "store_lookup": views.unique_documents(spark, sf).select("entry_id", "file_name"),
            "rate_limit_sequence, describe_rounds": views.flat_entries(spark, sf).select("entry_id", "input_pos", "media_type", "text_bytes"),
            "selected_outcome, selection_rows": gallery.classify_uploads(views.documents(spark, sf).select(F.col("input_pos").alias("position"), F.col("file_name").alias("name"), F.col("text_bytes").alias("n_bytes"), "file_hash"), views.unique_documents(spark, sf).where("lang = 'en'").select("entry_id", F.struct("file_hash").alias("metadata"))),
        }
        for names, rows in views_of.items():
            dealt = exchanged(rows)
            assert dealt and not any("text#" in x for x in dealt), names
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_texts_of_collection_rows_are_dealt_once(spark, sf):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = exchanged(QUERIES["collection_rows"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sum("text#" in x or "document#" in x for x in dealt) == 1


def test_uploads_by_hash(spark):
    data = [(1, "a", b"x"), (2, "b", b"x"), (3, "c", b""), (4, "d", None)]
    whole = spark.createDataFrame(data, "position long, name string, payload binary")
    hashed = whole.select("position", "name", F.octet_length("payload").alias("n_bytes"), F.sha2("payload", 256).alias("file_hash"))
    none = spark.createDataFrame([], "entry_id string, metadata struct<file_hash:string>")
    want = gallery.classify_uploads(whole, none).collect()
    assert gallery.classify_uploads(hashed, none).collect() == want and [r.duplicates for r in want] == [1]
