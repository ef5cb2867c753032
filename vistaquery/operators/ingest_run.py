"""An ingest as a whole: scanned files to entries, descriptions, collections and the marks of what is indexed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.media import entry_id
from ..functions.media import rigor as known_rigor
from ..sources.shared import written
from ..sources.store import BucketedStore
from . import catalog, ingest
from .describe import Call, describe_rounds

#: What a caller may override of a file's metadata; its hash, path and kind stay those of the file.
OVERRIDES = ["file_name", "uploaded_at"]


@dataclass(frozen=True)
class IngestSettings:
    api: str
    model: str
    indexed_at: str  #: the time that indexed entries are marked with
    rigor: str = "very low"
    update: bool = False  #: whether metadata and collections of known entries are written again
    limits: ingest.PackLimits = field(default_factory=ingest.PackLimits)


def _with_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    flat = files.withColumns({c: F.col(f"metadata.{c}") for c in ("file_path", *OVERRIDES)})
    given = catalog.overridden(flat, overrides, OVERRIDES)
    changed = F.col("metadata")
    for c in OVERRIDES:
        changed = changed.withField(c, F.col(c))
    return given.withColumn("metadata", changed).select(*files.columns)


def ingest_files(files: DataFrame, overrides: DataFrame, entries: BucketedStore, collections: BucketedStore, call: Call | None, rounds: str, settings: IngestSettings) -> DataFrame:
    """What became of each distinct content of files (position, raw_path, metadata, prepared, bytes), its stores changed.

    entries hold entry_id, metadata, description (a struct with content, context and perhaps
    generation.rigor) and indexing; collections hold item_id, collection and document.  overrides: path,
    file_name and uploaded_at, by normalized or raw path.  call: null to describe nothing.
    rounds: the folder of the describing rounds, by which an ingest that ended is gone on with.
    Returned are entry_id, known (whether described and indexed before), status (described, failed,
    rate_limited or null), reason and indexed."""
    own = catalog.last_wins(_with_overrides(files, overrides).withColumn("file_hash", F.col("metadata.file_hash")), "file_hash", "position")
    own = written(own.withColumn("entry_id", entry_id(F.col("file_hash"), settings.api, settings.model)).drop("file_hash"), "files")
    there = entries.lookup(own.select("entry_id"), catalog.has_description().alias("described"), catalog.indexed_at().isNotNull().alias("indexed"), F.col("metadata.dates.chroma_indexed_at").alias("marked"))
    state = written(own.select("entry_id", "prepared", "bytes").join(there, "entry_id", "left").withColumn("described", F.coalesce("described", F.lit(False))), "state")
    missing = state.where("not described").select("entry_id")
    entries.upsert(_metadata_of(own if settings.update else own.join(missing, "entry_id", "left_semi"), state))

    told = None
    if call is not None:
        todo = state.where("not described").select("entry_id", F.lit(0).alias("position"), "prepared", "bytes")  # in order of their ids
        batches = written(ingest.pack_sequence(todo, settings.limits), "batches").join(own.drop("prepared", "bytes", "position"), "entry_id")
        told = written(describe_rounds(batches, call, rounds, count=settings.limits.count).select("entry_id", "status", "reason", "description"), "told")
        entries.upsert(_descriptions_of(told.where("status = 'described'"), entries.schema["description"].dataType, settings.rigor))

    ready = entries.lookup(own.select("entry_id")).where(catalog.has_description())
    due = written(ready if settings.update else ready.where(catalog.indexed_at().isNull()), "due")
    items = catalog.classify(due).select(F.concat_ws("_", "entry_id", "collection").alias("item_id"), "collection", "document")
    if not settings.update:  # items that a collection has stay as they are
        have = collections.lookup_entries(due.select("entry_id")).select("item_id")
        items = items.join(have, "item_id", "left_anti")
    collections.upsert(written(items, "items"))
    entries.mark_indexed(due.select("entry_id"), F.lit(settings.indexed_at))

    out = state.select("entry_id", (F.col("described") & F.coalesce("indexed", F.lit(False))).alias("known"))
    if told is not None:
        out = out.join(told.select("entry_id", "status", "reason"), "entry_id", "left")
    else:
        out = out.withColumns({"status": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    return out.join(due.select("entry_id", F.lit(True).alias("indexed")), "entry_id", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def _metadata_of(own: DataFrame, state: DataFrame) -> DataFrame:
    """Fresh metadata; the mark of what is indexed stays, as it lies among the dates."""
    marked = own.join(state.select("entry_id", "marked"), "entry_id")
    dates = F.col("metadata.dates").withField("chroma_indexed_at", F.col("marked"))
    return marked.select("entry_id", F.col("metadata").withField("dates", dates).alias("metadata"))


def _descriptions_of(told: DataFrame, kind: T.StructType, rigor: str) -> DataFrame:
    said = F.from_json("description", kind)
    if "generation" in kind.names:
        generation = F.struct(*(known_rigor(F.lit(rigor)).alias(n) if n == "rigor" else said[f"generation.{n}"].alias(n) for n in kind["generation"].dataType.names))
        said = said.withField("generation", generation)
    return told.select("entry_id", said.alias("description"))

