"""Gallery, pending uploads and search history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.media import GALLERY_IMAGES, display_name
from .catalog import creation_date, fully_indexed, has_description, upload_date
from .order import numbered

#: Rows that a gallery shows, searches that are kept for each user.
GALLERY_LIMIT, HISTORY_LIMIT = 48, 30
#: What a table of results shows for each status, and the reason for a duplicate that is left as it is.
STATUS = {"stored": "stored", "re_uploaded": "re-uploaded", "ignored": "ignored", "indexed": "indexed", "rate_limited": "rate limited", "failed": "failed"}
DUPLICATE_REASON = "Duplicate already exists. Ignored by default."


def status() -> Column:
    return F.when(fully_indexed(), "indexed").when(has_description(), "pending_indexing").otherwise("pending_description")


def records(entries: DataFrame) -> DataFrame:
    name = display_name(F.col("metadata.file_name"), F.col("metadata.file_path"), F.col("entry_id"))
    return entries.select("entry_id", F.col("metadata.file_path").alias("file_path"), name.alias("file_name"), F.col("metadata.ext").alias("ext"), upload_date().alias("uploaded_at"), creation_date().alias("creation_date"), status().alias("status"))


#: Missing dates are the empty text, so they come last in falling and first in rising order.
ORDERS = {
    "upload_desc": lambda: [F.desc("uploaded_at"), "entry_id"],
    "upload_asc": lambda: [F.asc("uploaded_at"), "entry_id"],
    "created_desc": lambda: [F.desc("creation_date"), "entry_id"],
    "created_asc": lambda: [F.asc("creation_date"), "entry_id"],
    "name_asc": lambda: [F.lower("file_name"), "entry_id"],
    "name_desc": lambda: [F.desc(F.lower("file_name")), "entry_id"],
    "random": lambda: [F.rand(7)],
}


def gallery(entries: DataFrame, order: str = "upload_desc", limit: int = GALLERY_LIMIT) -> DataFrame:
    """The first images in an order, with their position (the top is taken before rows are numbered)."""
    by = ORDERS[order]()
    top = records(entries).where(F.col("ext").isin(GALLERY_IMAGES)).orderBy(*by).limit(limit)
    if order == "random":
        return top.withColumn("position", F.monotonically_increasing_id())
    return top.withColumn("position", F.row_number().over(Window.orderBy(*by)))


def pending(entries: DataFrame) -> DataFrame:
    """Entries that are not fully indexed, by upload date, with their place among those of their status and day."""
    rows = records(entries.where(~fully_indexed())).withColumn("day", F.substring("uploaded_at", 1, 10))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("status", "day").orderBy("uploaded_at", "entry_id")))


def pending_listed(entries: DataFrame) -> DataFrame:
    """Entries that are not fully indexed, with their place in the whole list by upload date; no task sees the whole list."""
    return numbered(records(entries.where(~fully_indexed())), [F.asc("uploaded_at"), F.asc("entry_id")])


def results_table(outcomes: DataFrame) -> DataFrame:
    """What an analysis shows of upload_outcome's rows: statuses by their labels, others as they are."""
    labels = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return outcomes.select("filename", F.coalesce(F.try_element_at(labels, F.col("status")), F.col("status"), F.lit("")).alias("status"), "reason", "entry_id")


def pending_table(entries: DataFrame) -> DataFrame:
    rows = entries.where(~fully_indexed())
    return rows.select(
        F.coalesce(F.nullif(F.col("metadata.file_name"), F.lit("")), F.col("entry_id")).alias("filename"),
        F.translate(F.substring(upload_date(), 1, 19), "T", " ").alias("uploaded_at"),
        F.substring(creation_date(), 1, 10).alias("creation_date"),
        "entry_id",
    )


def history_newest(history: DataFrame) -> DataFrame:
    """One row for each search of a user, the last, with its place from the newest on."""
    w = Window.partitionBy("history_user", "search_key").orderBy(F.desc("created_at"), F.desc("event_id"))
    one = history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("history_user").orderBy(F.desc("created_at"), F.desc("event_id"))))


def history_upsert(old: DataFrame, new: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """new searches (those without ids are not kept) into old ones; a user keeps the newest limit."""
    return history_newest(old.unionByName(new.where(F.size("ids") > 0))).where(F.col("position") <= limit)


def history_label(created_at: Column, query: Column, ids: Column) -> Column:
    """What a list of searches shows of one: when (an ISO text), what and how many results."""
    when = F.replace(F.substring(F.coalesce(created_at, F.lit("")), 1, 16), F.lit("T"), F.lit(" "))
    text = F.coalesce(F.nullif(query, F.lit("")), F.lit("Untitled search"))
    count = F.when(ids.isNull(), 0).otherwise(F.size(ids))
    return F.concat(when, F.lit(" · "), text, F.lit(" · "), count, F.lit(" result(s)"))


def normalized_history(history: DataFrame, ident: str = "event_id", at: str = "created_at") -> DataFrame:
    """history with ids as text and times as ISO text, to the second, in the session's zone; times without a zone are UTC, texts stay."""
    kind = history.schema[at].dataType
    when = F.col(at)
    if isinstance(kind, T.TimestampNTZType):
        when = F.to_timestamp(F.concat(F.date_format(when, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")), "yyyy-MM-dd HH:mm:ss.SSSSSSxxx")
    text = when if isinstance(kind, T.StringType) else F.date_format(when, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return history.withColumns({ident: F.col(ident).cast("string"), at: text})


def clean_scores(scores: Column) -> Column:
    """Numbers of a list of texts; bad ones go, nulls stay."""
    x = F.transform(scores, lambda s: F.struct(s.alias("s"), s.try_cast("double").alias("v")))
    return F.transform(F.filter(x, lambda y: y["s"].isNull() | y["v"].isNotNull()), lambda y: y["v"])


def classify_uploads(uploads: DataFrame, entries: DataFrame) -> DataFrame:
    """Of a selection (position, name, payload): the first of each payload, with what is stored and what to do.

    In place of the payload its n_bytes and file_hash may be given."""
    told = uploads if "file_hash" in uploads.columns else uploads.select("position", "name", F.octet_length("payload").alias("n_bytes"), F.sha2("payload", 256).alias("file_hash"))
    hashed = told.where("n_bytes > 0")
    w = Window.partitionBy("file_hash")
    first = hashed.withColumn("_n", F.row_number().over(w.orderBy("position"))).withColumn("duplicates", F.count("*").over(w) - 1).where("_n = 1")
    stored = entries.select(F.col("metadata.file_hash").alias("file_hash"), F.col("entry_id").alias("existing")).groupBy("file_hash").agg(F.min("existing").alias("existing"))
    joined = first.join(stored, "file_hash", "left")
    return joined.select("file_hash", F.col("name").alias("original_filename"), "duplicates", "existing", F.when(F.col("existing").isNotNull(), "ignore").otherwise("").alias("default_action"))


def _actions(selections: DataFrame, overrides: DataFrame) -> DataFrame:
    """selections with action: nothing for new files, else that of overrides (file_hash, action), else the default."""
    chosen = selections.join(overrides.select("file_hash", F.col("action").alias("_own")), "file_hash", "left")
    return chosen.withColumn("action", F.when(F.col("existing").isNull(), "").otherwise(F.coalesce("_own", "default_action"))).drop("_own")


def selection_rows(selections: DataFrame, overrides: DataFrame) -> DataFrame:
    """The table of a selection (classify_uploads) in which duplicates can be chosen for another upload."""
    rows = _actions(selections, overrides)
    there = F.col("existing").isNotNull()
    return rows.select("file_hash", F.col("original_filename").alias("filename"), F.when(there, "duplicate").otherwise("new").alias("status"), F.coalesce("existing", F.lit("")).alias("existing_entry_id"), (there & (F.col("action") == "reupload")).alias("re_upload"))


def edited_actions(overrides: DataFrame, edited: DataFrame) -> DataFrame:
    """overrides (file_hash, action) after an edit of selection_rows (position tells their order): rows of
    duplicates replace their hash's action, the last of a hash counts, others stay."""
    named = edited.where("file_hash <> '' and existing_entry_id <> ''")
    last = named.groupBy("file_hash").agg(F.max_by(F.coalesce("re_upload", F.lit(False)), "position").alias("again"))
    rows = last.select("file_hash", F.when(F.col("again"), "reupload").otherwise("ignore").alias("action"))
    return overrides.select("file_hash", "action").join(rows, "file_hash", "left_anti").unionByName(rows)


def selected_outcome(selections: DataFrame, overrides: DataFrame, entry_id: Column) -> DataFrame:
    """What becomes of each selected file: ignored (with the stored entry's id), re-uploaded or stored; entry_id: of file_hash."""
    rows = _actions(selections, overrides)
    ignored = F.col("existing").isNotNull() & (F.col("action") != "reupload")
    status = F.when(ignored, "ignored").when(F.col("existing").isNotNull(), "re_uploaded").otherwise("stored")
    return rows.select(F.col("original_filename").alias("filename"), "file_hash", status.alias("status"), F.when(ignored, DUPLICATE_REASON).otherwise("").alias("reason"), F.when(ignored, F.col("existing")).otherwise(entry_id).alias("entry_id"))


def analysis_overrides(entries: DataFrame) -> DataFrame:
    """What the stored files of entries keep when they are read again: path, file_name and uploaded_at, blank ones null."""
    kept = lambda c: F.nullif(F.col(f"metadata.{c}"), F.lit("")).alias(c)
    return entries.where("metadata.file_path <> ''").select(F.col("metadata.file_path").alias("path"), kept("file_name"), kept("uploaded_at"))


def upload_outcome(entries: DataFrame, outcome: DataFrame) -> DataFrame:
    """Status and reason of each pending entry from outcome (entry_id, kind, reason); indexed before rate-limited before failed."""
    order = F.array_position(F.array(*map(F.lit, ("indexed", "rate_limited", "failed"))), F.col("kind"))
    best = outcome.groupBy("entry_id").agg(F.min(F.struct(order.alias("o"), "kind")).alias("b"), F.max("reason").alias("reason")).select("entry_id", "b.kind", "reason")
    joined = entries.join(best, "entry_id", "left")
    reason = (
        F.when(F.col("kind") == "indexed", "")
        .when(F.col("kind") == "rate_limited", F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("Quota reached while generating descriptions.")))
        .when(F.col("kind") == "failed", F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("Analysis failed.")))
        .otherwise("Analysis did not complete.")
    )
    name = F.coalesce(F.nullif(F.col("metadata.file_name"), F.lit("")), F.col("entry_id"))
    return joined.select("entry_id", name.alias("filename"), F.coalesce(F.col("metadata.file_hash"), F.lit("")).alias("file_hash"), F.coalesce("kind", F.lit("failed")).alias("status"), reason.alias("reason"))
