"""The catalog over the test tables: documents stand for files, orders and events give dates, labels reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import entry_id, media_type, mime_type
from ..functions.text import tokenized
from ..operators.catalog import last_wins

API, MODEL = "gemini", "test-model"
EXTENSIONS = ["jpg", "jpeg", "png", "webp", "heic", "mp4", "mov", "tiff", "bmp", "svg", "avif", "txt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(n: int) -> Column:
    """The first or second line of text, null where there is none."""
    return F.try_element_at(F.split("text", "\n", 3), F.lit(n))  # the third holds the rest


def documents(spark: SparkSession, sf_dir: str, **of_text: Column) -> DataFrame:
    """What a document alone tells of its entry; of_text: further columns made of the text, or text and its lines made shorter.

    All that a text gives is made where it is read, so that a plan that needs its hash, length or
    lines alone sends no text through a shuffle."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        k.alias("input_pos"), "lang", "source", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").alias("text_bytes"),
        F.element_at(F.array(*map(F.lit, EXTENSIONS)), (k % 12 + 1).cast("int")).alias("ext"), (k % 4 != 1).alias("described"),
        *(c.alias(name) for name, c in ({"line1": line(1), "line2": line(2), "text": F.col("text")} | of_text).items()),
    )
    rows = rows.withColumns({
        "entry_id": entry_id(F.col("file_hash"), API, MODEL),
        "file_path": F.concat(F.lit("/lib/"), "source", F.lit("/"), "input_pos", F.lit("."), "ext"),
        "file_name": F.when(F.col("input_pos") % 10 == 0, "").otherwise(F.concat("input_pos", F.lit("."), "ext")),
        "media_type": media_type(F.col("ext")),
    })
    return rows.withColumn("mime_type", mime_type(F.col("ext"), F.col("media_type")))


def flat_entries(spark: SparkSession, sf_dir: str, **of_text: Column) -> DataFrame:
    """One row per document, as the CTE e of the oracle; of_text as in documents(). Dates become text after the joins."""
    d = documents(spark, sf_dir, **of_text)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input_pos"), "o_orderdate")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("input_pos"), "ts")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("input_pos"), "quality")
    k = F.col("input_pos")
    offset = F.when(k % 3 == 0, "+00:00").when(k % 3 == 1, "-07:00").otherwise("+05:30")
    moment = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    rows = d.join(o, "input_pos", "left").join(ev, "input_pos", "left").join(lab, "input_pos", "left").withColumns({
        "index_date": moment,
        "uploaded_at": F.when(k % 5 != 0, moment),
        "master_date": F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss.SSSSSS"), offset),
        "date_reliability": F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("unknown"),
    })
    return rows.drop("o_orderdate", "ts").withColumns({
        "true_creation_date": F.when(k % 7 == 0, "").otherwise(F.col("master_date")),
        "indexed_at": F.when(k % 3 == 0, F.col("index_date")),
        "legacy_indexed_at": F.when(k % 6 == 1, F.col("index_date")),
    })


def nested(flat: DataFrame, *more: Column) -> DataFrame:
    """Entries with metadata, description and indexing, and input_pos; more: columns of flat beside them."""
    s = F.lit(None).cast("string")
    dates = F.struct("master_date", "true_creation_date", s.alias("true_modification_date"), "index_date", F.col("true_creation_date").alias("creation_date"), s.alias("modification_date"), "date_reliability", F.col("indexed_at").alias("chroma_indexed_at"))
    content = F.struct(F.col("line1").alias("summary"), F.array("lang", "source").alias("objects"), F.col("line2").alias("text"), F.array(F.col("lang")).alias("vibe"), F.col("lang").alias("background"), F.col("text").alias("detailed_description"), F.lit("").alias("miscellaneous"))
    context = F.struct(F.col("source").alias("primary_category"), F.lit("").alias("intent"), F.col("ext").alias("composition"), F.col("master_date").alias("estimated_date"), F.col("line1").alias("event"), s.alias("analysis"), F.col("source").alias("metadata_relevance"), F.col("line2").alias("other_details"))
    return flat.select(
        "input_pos", "entry_id",
        F.struct("file_hash", "file_path", "file_name", "media_type", "ext", "mime_type", dates.alias("dates"), "uploaded_at").alias("metadata"),
        F.when(F.col("described"), F.struct(content.alias("content"), context.alias("context"))).alias("description"),
        F.struct(F.col("legacy_indexed_at").alias("chroma_indexed_at")).alias("indexing"), *more,
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(flat_entries(spark, sf_dir))


def unique_entries(spark: SparkSession, sf_dir: str, **of_text: Column) -> DataFrame:
    """The last document of each text."""
    return last_wins(flat_entries(spark, sf_dir, **of_text), "file_hash", "input_pos")


def whole_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_entries for plans that need the texts: these meet the dates by hash, where they are dealt to once, not on their way through the joins; lines are made of them there."""
    texts = last_wins(documents(spark, sf_dir).select("file_hash", "input_pos", "text"), "file_hash", "input_pos").drop("input_pos")
    return unique_entries(spark, sf_dir).drop("text", "line1", "line2").join(texts, "file_hash").withColumns({"line1": line(1), "line2": line(2)})


def unique_documents(spark: SparkSession, sf_dir: str, **of_text: Column) -> DataFrame:
    """As unique_entries, without dates and reliability, for which other tables would be read."""
    return last_wins(documents(spark, sf_dir, **of_text), "file_hash", "input_pos")


def collection_docs(spark: SparkSession, sf_dir: str, unique: DataFrame | None = None, *more: str) -> DataFrame:
    """(collection, entry_id, document, tokens, token_string, token_count) of the unique entries (unique: a table of them that is there); more: its columns beside them."""
    rows = [("content_narrative", F.col("text")), ("context_narrative", F.col("line1")), ("lexical_keywords", F.concat_ws(", ", "lang", "source")), ("ocr_content", F.col("line2")), ("other_data", F.col("source"))]
    unique = unique_documents(spark, sf_dir) if unique is None else unique
    docs = unique.select("entry_id", *more, F.explode(F.array(*(F.struct(F.lit(c).alias("collection"), x.alias("document")) for c, x in rows))).alias("x"))
    docs = docs.select("x.collection", "entry_id", "x.document", *more).where(F.coalesce(F.col("document") != "", F.lit(False)))
    return tokenized(docs, "document")


def vectors(spark: SparkSession, sf_dir: str, unique: DataFrame | None = None) -> DataFrame:
    """Embeddings of the unique entries whose number they have, as those of the long texts."""
    unique = unique_documents(spark, sf_dir) if unique is None else unique
    e = unique.select("entry_id", F.col("input_pos").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(e, "vec_id").select(F.lit("content_narrative").alias("collection"), "entry_id", "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, which stands for a model's embedding of a query text."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]
