"""Plan-time code and single operators: masks, filters, packing, specifications, plans."""

from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vistaquery.functions import dates, masks, media
from vistaquery.operators import catalog, filters, gallery, ranking
from vistaquery.operators.ingest import PackLimits, pack
from vistaquery.plans.query import specify, tokens_of
from vistaquery.sources import views
from vistaquery.sources.scan import file_metadata, scan_folder, scan_paths
from vistaquery.streaming.ingest import ingest_stream


def test_bounds_and_specificity():
    utc = timezone.utc
    assert masks.bounds("2021-05-XXTXX:XX:XX") == (datetime(2021, 5, 1, tzinfo=utc), datetime(2021, 5, 31, 23, 59, 59, tzinfo=utc))
    assert masks.bounds("2023-02-3XTXX:XX:XX")[1].day == 28
    with pytest.raises(ValueError):
        masks.bounds("2021-05-01T2X:XX:XX")
    with pytest.raises(ValueError):
        masks.groups("2021-5-1")
    assert masks.specificity("2021-05-XXTXX:XX:XX", "2021-05-XXTXX:XX:XX") == 4
    assert masks.specificity("bad", "2021-05-XXTXX:XX:XX") == 0
    with pytest.raises(ValueError):
        masks.condition("other_date", masks.DateFilter("2021-XX-XXTXX:XX:XX", "2021-XX-XXTXX:XX:XX", "single_mask"))


digit = st.sampled_from("0123456789X")
mask = st.builds(lambda d: "{}{}{}{}-{}{}-{}{}T{}{}:{}{}:{}{}".format(*d), st.lists(digit, min_size=14, max_size=14))


@given(mask, mask)
def test_specificity_range(a, b):
    assert 0 <= masks.specificity(a, b) <= 12


def test_extract_filters():
    found, text = masks.extract_filters("2021-05-XXTXX:XX:XX until 2021-06-XXTXX:XX:XX in Summer night 202X-XX-XXTXX:XX:XX")
    assert [f.source for f in found] == ["explicit_range", "single_mask", "semantic", "semantic"]
    assert text == "in summer night" and {f.key for f in found} == {None, "summer", "night"}
    assert masks.extract_filters("summertime")[0] == []
    found, text = masks.extract_filters("  noon 202x-XX-XXTXX:XX:XX - 2022-01-01T00:00:00, Noon in the Golden hour 202X-XX-XXTXX:XX:XX 202X-XX-XXTXX:XX:XX ")
    assert [(f.source, f.start_mask[:4], f.end_mask[:4], f.key, f.matched_text) for f in found[2:]] == [("semantic", "XXXX", "XXXX", "golden hour", "Golden hour"), ("semantic", "XXXX", "XXXX", "noon", "noon")]
    assert [(f.source, f.start_mask[:4], f.end_mask[:4]) for f in found[:2]] == [("explicit_range", "202X", "2022"), ("single_mask", "202X", "202X")]
    assert text == "noon , noon in the golden hour"


@pytest.mark.parametrize("key", masks.SEMANTIC)
def test_every_phrase_is_found_alone(key):
    assert [f.key for f in masks.extract_filters(f"at {key.upper()}, then")[0]] == [key]


def test_recurring_condition_is_tuple_order(spark):
    f = masks.DateFilter("XXXX-11-20TXX:XX:XX", "XXXX-12-31TXX:XX:XX", "semantic")
    rows = spark.range(1, 13).select(F.col("id").cast("int").alias("master_month")).crossJoin(spark.range(1, 32).select(F.col("id").cast("int").alias("master_day")))
    got = {tuple(r) for r in rows.where(masks.recurring_condition("master_date", f)).collect()}
    assert got == {(m, d) for m in range(1, 13) for d in range(1, 32) if (11, 20) <= (m, d) <= (12, 31)}


def test_specify():
    specs = specify(["  Die der ", ["die DER", ["x the"]], ""])
    assert [s.text for s in specs] == ["die der", "x the"] and specs[1].tokens == ()
    assert tokens_of("Éclair of the Sun-rise sun") == ["clair", "sun", "rise", "sun"]


@settings(max_examples=60)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 60)), max_size=40), st.integers(1, 5))
def test_pack_keeps_limits(items, count):
    limits = PackLimits(count=count, bytes=100, base=45)
    found = list(pack(iter(items), limits))
    batches = {}
    for (ok, size), (b, outcome) in zip(items, found):
        batches.setdefault(b, []).append((size, outcome))
        assert (outcome == "unprepared") == (not ok) and (outcome == "too_large") == (ok and size > 55)
    assert [b for b, _ in found] == sorted(b for b, _ in found)
    for group in batches.values():
        assert len(group) == 1 or len(group) <= count and all(o == "packed" for _, o in group) and 45 + sum(s for s, _ in group) <= 100


def test_pack_batch_sizes():
    for name, n in (("low", 20), ("medium", 10), ("high", 5), ("very high", 2), ("extreme", 1)):
        assert [b for b, _ in pack(iter([(True, 1)] * (n + 1)), PackLimits(count=media.BATCH_SIZES[name]))] == [1] * n + [2]


def test_fit_size(spark):
    rows = spark.createDataFrame([(4000, 3000), (3000, 4000), (1200, 800), (5, 100000)], "w int, h int")
    w, h = media.fit_size(F.col("w"), F.col("h"), 1600, 1600)
    assert [tuple(r) for r in rows.select(w, h).collect()] == [(1600, 1200), (1200, 1600), (1200, 800), (1, 1600)]


def test_date_parts_keep_the_offset(spark):
    row = spark.createDataFrame([("2021-05-01T08:15:00.25-07:00",), ("nonsense",)], "x string").select(*(c.alias(k) for k, c in dates.date_part_columns(F.col("x"), "m").items())).collect()
    assert row[0].m_hour == 8 and row[0].m_tz_offset_minutes == -420 and row[0].m_microsecond == 250000
    assert row[0].m_ts == datetime(2021, 5, 1, 15, 15, 0, 250000, tzinfo=timezone.utc).timestamp() and row[1].m_year is None


def test_filters():
    f = filters.ActiveFilters(min_score=0.1)
    assert f.active and f.candidates(5) == 25 and f.candidates(50) == 100 and filters.ActiveFilters().candidates(5) == 5


def test_fusion_does_not_depend_on_partitions(spark):
    rows = [("q", f"l{k % 3}", f"e{k % 7}", float(k), k // 3 + 1) for k in range(21)]
    hits = spark.createDataFrame(rows, "query_id string, list string, entry_id string, distance double, rank int")
    a, b = (ranking.fuse(hits.repartition(n), 5).collect() for n in (1, 7))
    model = {}
    for _, _, e, _, r in rows:
        model[e] = model.get(e, 0) + 0.2 / (60 + r)
    best = sorted(model, key=lambda e: (-round(model[e], 9), e))[:5]
    assert [r.entry_id for r in sorted(a, key=lambda r: r["rank"])] == best and sorted(a) == sorted(b)


def test_plans(spark, sf):
    """Top-k is cut before the shuffle, and a scan reads only the columns that it needs."""
    plan = ranking.lexical_rank(views.collection_docs(spark, sf), specify(["die der"]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = views.flat_entries(spark, sf).select("input_pos", "ext")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema: ")[1].split(">")[0]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "entry_id string, metadata string, description string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "entry_id string, metadata string")
    once = catalog.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "1", "x"), ("b", "3", "y"), ("c", "4", None)]
    assert sorted(map(tuple, catalog.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_gallery_places_missing_dates(spark, sf):
    rows = views.entries(spark, sf).withColumn("metadata", F.col("metadata").withField("dates", F.col("metadata.dates").withField("true_creation_date", F.lit("")).withField("master_date", F.when(F.col("input_pos") > 3, "2024-01-01"))))
    assert gallery.gallery(rows, "created_asc", 3).orderBy("position").first().creation_date == ""
    assert gallery.gallery(rows, "created_desc", 3).orderBy("position").first().creation_date == "2024-01-01"


def test_scan_and_stream(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, data in (("in/a.JPG", b"one"), ("in/sub/b.mp4", b"two"), ("in/c.txt", b"one")):
        (tmp_path / name).write_bytes(data)
    rows = {r.file_name: r for r in file_metadata(scan_folder(spark, str(tmp_path / "in"))).collect()}
    assert rows["a.JPG"].ext == "jpg" and rows["a.JPG"].mime_type == "image/jpeg" and rows["b.mp4"].media_type == "video" and rows["c.txt"].media_type == ""
    assert rows["a.JPG"].file_hash == rows["c.txt"].file_hash
    listed = file_metadata(scan_paths(spark, [str(tmp_path / "in/c.txt"), str(tmp_path / "in/a.JPG")]))
    assert [r.file_name for r in catalog.last_wins(listed, "file_hash", "position").collect()] == ["a.JPG"]
    out = str(tmp_path / "out")
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), lambda df, k: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_config_and_helpers():
    from vistaquery.plans import config

    c = config.IngestConfig.from_env("X_", {"X_RIGOR": " High ", "X_DUMMY": "yes", "X_MAX_WIDTH": "10"})
    assert (c.batch_size, c.dummy_descriptions, c.max_width, c.update_mode) == (5, True, 10, False)
    assert config.IngestConfig(rigor="?").batch_size == 50 and not config.IngestConfig().can_describe(None)
    with pytest.raises(ValueError):
        config.required({}, "X")
    assert config.render("a __x__ __y__", {"x": "1"}) == "a 1 __y__"
    assert config.merge({"a": {"b": 1}, "l": [1], "s": 1}, {"a": {"c": 2}, "l": [2], "s": 3}) == {"a": {"b": 1, "c": 2}, "l": [1, 2], "s": 3}
    assert config.decode("é".encode()) == "é" and config.decode("ab".encode("utf-16")) == "ab" and config.decode(b"\xe9\x00") == "é"
    assert config.embedding_chunk(100, 4) == 13 and config.embedding_chunk(100, 4, 32) == 32
    t = config.Timings()
    with t.step("a"):
        pass
    assert set(t.seconds) == {"a"}


def test_files(spark, tmp_path):
    from vistaquery.sources.files import delete_entries, delete_files, store_upload

    root, now = str(tmp_path / "up"), datetime(2024, 3, 5)
    path = store_upload(root, b"x", "a\\B.JPG", now)
    assert "/20240305/" in path and path.endswith(".jpg") and store_upload(root, b"x", "other.png", datetime(2025, 1, 1)) == path
    other = store_upload(root, b"y", "n", now)
    (tmp_path / "outside").write_bytes(b"")
    assert delete_files([path, str(tmp_path / "outside"), path + "?"], root) == 1 and (tmp_path / "outside").exists()
    assert delete_entries(spark.createDataFrame([([other],)], "paths array<string>"), root) == 1
    assert not list((tmp_path / "up").iterdir())


def test_embed(spark):
    from vistaquery.operators.embed import embed

    docs = spark.createDataFrame([("content_narrative", "abc"), ("other_data", "de"), ("else", "f")], "collection string, document string")
    models = {"sentence": lambda xs: [[len(x), 1] for x in xs], "word": lambda xs: [[len(x), 2] for x in xs]}
    assert {r.document: r.embedding for r in embed(docs, models).collect()} == {"abc": [3.0, 1.0], "de": [2.0, 2.0], "f": None}


def test_renaming_a_hash_that_no_entry_has_is_an_error(spark, sf):
    from vistaquery.operators import catalog
    from vistaquery.sources.views import entries

    with pytest.raises(LookupError):
        catalog.rename_by_hash(entries(spark, sf), "none", "x.jpg")
