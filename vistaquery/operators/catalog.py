"""The algebra of the catalog: projections, last-wins and best-of dedupe, upserts, deletes, states.

Entries are rows (entry_id, metadata, description, indexing).  Every operator returns the new
table; none of them collects, and each needs one shuffle by entry_id or file_hash at most, the
deletion by prefix included (it is an equi-join on the entry's part of the id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_part_columns
from ..functions.text import blank_to_null, combine, list_part, sentence_part, token_columns, word_part

#: The fields of each collection.
COLLECTIONS = {
    "content_narrative": ["summary", "detailed_description", "miscellaneous", "background", "objects"],
    "context_narrative": ["event", "analysis", "other_details", "vibe"],
    "lexical_keywords": ["primary_category", "intent", "vibe", "composition", "background", "objects"],
    "ocr_content": ["ocr_text"],
    "other_data": ["metadata_relevance"],
}
#: Where a field is, and how it is written.
FIELDS = {
    "summary": ("content.summary", sentence_part), "detailed_description": ("content.detailed_description", sentence_part),
    "ocr_text": ("content.text", sentence_part), "miscellaneous": ("content.miscellaneous", sentence_part),
    "background": ("content.background", word_part), "objects": ("content.objects", list_part), "vibe": ("content.vibe", list_part),
    "primary_category": ("context.primary_category", word_part), "intent": ("context.intent", word_part),
    "composition": ("context.composition", word_part), "event": ("context.event", sentence_part),
    "analysis": ("context.analysis", sentence_part), "other_details": ("context.other_details", sentence_part),
    "metadata_relevance": ("context.metadata_relevance", sentence_part), "estimated_date": ("context.estimated_date", sentence_part),
}
ENTRY_ID_LENGTH = 105


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """The row with the greatest position of each key; blank keys go."""
    w = Window.partitionBy(key).orderBy(F.desc(position))
    return df.where(F.coalesce(F.col(key) != "", F.lit(False))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upload_date() -> Column:
    return F.coalesce(blank_to_null(F.col("metadata.uploaded_at")), blank_to_null(F.col("metadata.dates.index_date")), F.lit(""))


def creation_date() -> Column:
    return F.coalesce(blank_to_null(F.col("metadata.dates.true_creation_date")), blank_to_null(F.col("metadata.dates.master_date")), F.lit(""))


def has_description() -> Column:
    return F.col("description.content").isNotNull()


def indexed_at() -> Column:
    return F.coalesce(blank_to_null(F.col("metadata.dates.chroma_indexed_at")), blank_to_null(F.col("indexing.chroma_indexed_at")))


def fully_indexed() -> Column:
    return has_description() & indexed_at().isNotNull()


def best_by_hash(entries: DataFrame, position: str) -> DataFrame:
    """One entry per file_hash: latest upload date, then fully indexed, then described, then first."""
    w = Window.partitionBy("metadata.file_hash").orderBy(F.desc(upload_date()), F.desc(fully_indexed()), F.desc(has_description()), position)
    return entries.where(F.coalesce(F.col("metadata.file_hash") != "", F.lit(False))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extract_fields(entries: DataFrame) -> DataFrame:
    return entries.select("entry_id", *(F.col(f"description.{path}").alias(name) for name, (path, _) in FIELDS.items()))


def classify(entries: DataFrame) -> DataFrame:
    """(collection, entry_id, document) of the entries with metadata; collections without text are left out."""
    documents = [F.struct(F.lit(c).alias("collection"), combine([FIELDS[f][1](F.col(f"description.{FIELDS[f][0]}")) for f in fields]).alias("document")) for c, fields in COLLECTIONS.items()]
    rows = entries.where(F.col("metadata").isNotNull()).select("entry_id", F.explode(F.array(*documents)).alias("x"))
    return rows.select("x.collection", "entry_id", "x.document").where("document is not null")


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumns(token_columns(F.col("document")))


def with_dates(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """docs of the dated collection with their entries' date parts and reliability (missing: unknown)."""
    parts = {}
    for name, source in (("master", "master_date"), ("creation", "true_creation_date"), ("modification", "true_modification_date"), ("index", "index_date")):
        parts |= date_part_columns(F.col(f"metadata.dates.{source}"), name)
    dates = entries.select("entry_id", *(c.alias(k) for k, c in parts.items()), F.coalesce(blank_to_null(F.col("metadata.dates.date_reliability")), F.lit("unknown")).alias("date_reliability"))
    return docs.where("collection = 'context_narrative'").join(dates, "entry_id", "left")


def explode_documents(df: DataFrame, lists: str | None = None, maps: str | None = None) -> DataFrame:
    """Rows (id, document): list elements as id_item_1, ..., map values as id_key; blank ones go."""
    if lists:
        rows = df.select("id", F.posexplode(lists).alias("k", "document")).select(F.concat("id", F.lit("_item_"), F.col("k") + 1).alias("id"), "document")
    elif maps:
        rows = df.select("id", F.explode(maps).alias("k", "document")).select(F.concat_ws("_", "id", "k").alias("id"), "document")
    else:
        rows = df.select("id", "document")
    return rows.where(F.coalesce(F.col("document") != "", F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: str = "entry_id") -> DataFrame:
    """Columns of new replace those of old, whole; rows of old alone and of new alone stay."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def missing_only(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(existing.select(*keys), keys, "left_anti")


def mark_indexed(entries: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Sets the one leaf metadata.dates.chroma_indexed_at of the entries named."""
    hit = entries.join(ids.select("entry_id").distinct().withColumn("_hit", F.lit(True)), "entry_id", "left")
    leaf = F.col("metadata").withField("dates", F.col("metadata.dates").withField("chroma_indexed_at", at))
    return hit.withColumn("metadata", F.when(F.col("_hit"), leaf).otherwise(F.col("metadata"))).drop("_hit")


def delete_prefixed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (id) but those whose id is a deleted one or begins with it and an underscore."""
    own = F.when(F.length("id") > ENTRY_ID_LENGTH, F.when(F.substring("id", ENTRY_ID_LENGTH + 1, 1) == "_", F.substring("id", 1, ENTRY_ID_LENGTH))).otherwise(F.col("id"))
    return rows.withColumn("_entry", own).join(ids.select(F.col("entry_id").alias("_entry")).distinct(), "_entry", "left_anti").drop("_entry")


def delete_by_hash(entries: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left, and per hash the sorted distinct paths and ids that went."""
    named = hashes.select("file_hash").distinct()
    flat = entries.withColumn("file_hash", F.col("metadata.file_hash"))
    gone = flat.join(named, "file_hash", "left_semi").groupBy("file_hash").agg(F.sort_array(F.collect_set("metadata.file_path")).alias("paths"), F.sort_array(F.collect_set("entry_id")).alias("ids"))
    return flat.join(named, "file_hash", "left_anti").drop("file_hash"), gone


def rename_by_hash(entries: DataFrame, file_hash: str, name: str) -> DataFrame:
    """entries with the base name of name for that content; a hash that no entry has is an error."""
    name = name.replace("\\", "/").split("/")[-1].strip()
    if not name:
        raise ValueError("a name is needed")
    if entries.where(F.col("metadata.file_hash") == file_hash).isEmpty():
        raise LookupError(f"no entry has the hash {file_hash}")
    renamed = F.col("metadata").withField("file_name", F.lit(name))
    return entries.withColumn("metadata", F.when(F.col("metadata.file_hash") == file_hash, renamed).otherwise(F.col("metadata")))


def missing_fields(ids: DataFrame, entries: DataFrame, fields: list[str]) -> DataFrame:
    """ids without an entry, or whose entry lacks one of the fields."""
    there = entries.where(" and ".join(f"{f} is not null" for f in fields) or "true").select("entry_id")
    return ids.join(there, "entry_id", "left_anti")


def overridden(files: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """files with values of overrides (path), matched by the normalized path first, then by the raw one."""
    o = overrides.groupBy("path").agg(*(F.first(c, True).alias(c) for c in columns))
    a = o.select(F.col("path").alias("file_path"), F.struct(*columns).alias("_a"))
    b = o.select(F.col("path").alias("raw_path"), F.struct(*columns).alias("_b"))
    joined = files.join(a, "file_path", "left").join(b, "raw_path", "left").withColumn("_o", F.coalesce("_a", "_b"))
    return joined.withColumns({c: F.coalesce(F.col(f"_o.{c}"), F.col(c)) for c in columns}).drop("_a", "_b", "_o")


def collection_get(rows: DataFrame, ids: DataFrame | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """rows (collection, entry_id, ...) of ids (entry_id) that a condition holds for; of each collection the first limit by id."""
    found = rows if ids is None else rows.join(ids.select("entry_id").distinct(), "entry_id", "left_semi")
    found = found if where is None else found.where(where)
    if limit is None:
        return found
    # which rows are first is told by their keys alone; whole rows are taken for these few
    first = lambda x: x.withColumn("_n", F.row_number().over(Window.partitionBy("collection").orderBy("entry_id"))).where(F.col("_n") <= limit).drop("_n")
    keys = first(found.select("collection", "entry_id")).distinct()
    return first((rows if where is None else rows.where(where)).join(F.broadcast(keys), ["collection", "entry_id"], "left_semi"))


def browse_rows(rows: DataFrame, metadata: list[str], embedding: str | None = None) -> DataFrame:
    """What a viewer lists of rows (collection, entry_id, document, ...): the names of the metadata columns that are set, and the embedding's shape."""
    keys = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(metadata)))), ", ")
    shape = F.lit("") if embedding is None else F.when(F.col(embedding).isNull(), "").otherwise(F.concat(F.lit("("), F.size(embedding), F.lit(",)")))
    return rows.select("collection", F.col("entry_id").alias("id"), F.coalesce("document", F.lit("")).alias("document"), keys.alias("metadata_keys"), shape.alias("embedding"))


def jsonable(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object; nested records and lists stay nested, other kinds of value are text."""

    def plain(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*(plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: plain(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string"), plain(e["value"], kind.valueType))))
        return value if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType) else value.cast("string")

    return rows.select(F.to_json(F.struct(*(plain(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields)), {"ignoreNullFields": "false"}).alias("json"))
