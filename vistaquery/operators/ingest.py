"""Ingest: packing of description requests, outcomes of calls, model responses, states."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import BATCH_SIZES, MAX_INLINE_BYTES, entry_id, model_hash
from ..functions.media import rigor as known_rigor
from ..sources.shared import written
from .catalog import fully_indexed, has_description, indexed_at
from .order import numbered

PACKED = "shard string, entry_id string, position long, batch_no int, outcome string"


@dataclass(frozen=True)
class PackLimits:
    count: int = BATCH_SIZES["very low"]
    bytes: int = MAX_INLINE_BYTES
    base: int = 0  #: bytes of a request without items


def pack(sizes: Iterator[tuple[bool, int]], limits: PackLimits) -> Iterator[tuple[int, str]]:
    """Batch number and outcome (packed, unprepared, too_large) of each item (prepared, bytes), in order.

    An item that cannot be prepared, or is too large for any request, ends the open batch and
    stands alone; a batch is full at its count, and ends before an item that would be too much."""
    number = held = size = 0
    for prepared, item in sizes:
        alone = limits.base + item
        if prepared and held and size + item <= limits.bytes:
            held, size = held + 1, size + item
        else:
            number += 1
            held, size = (1, alone) if prepared and alone <= limits.bytes else (0, 0)
        yield number, "packed" if held else "too_large" if prepared else "unprepared"
        if held >= limits.count:
            held = size = 0


def pack_batches(items: DataFrame, limits: PackLimits) -> DataFrame:
    """items (shard, entry_id, position, prepared, bytes), packed in order of position within each
    shard.  A shard bounds what one task holds; choose one of a bounded range of positions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", ignore_index=True)
        found = list(pack(zip(pdf["prepared"].tolist(), pdf["bytes"].tolist()), limits))
        return pdf[["shard", "entry_id", "position"]].assign(batch_no=[b for b, _ in found], outcome=[o for _, o in found])

    return items.groupBy("shard").applyInPandas(run, PACKED)


def _next_starts(prepared: np.ndarray, size: np.ndarray, limits: PackLimits) -> tuple[np.ndarray, np.ndarray]:
    """For a batch that starts at each item, where the next one starts; and which items are packed."""
    n = len(size)
    total = np.concatenate([[0], np.cumsum(np.where(prepared, size, 0))])
    packed = prepared & (limits.base + size <= limits.bytes)
    fits = np.searchsorted(total, total[:-1] + limits.bytes - limits.base, side="right") - 1
    stops = np.flatnonzero(~prepared)
    stop = np.append(stops, n)[np.searchsorted(stops, np.arange(n), side="right")]
    ends = np.minimum(np.minimum(np.arange(n) + limits.count, fits), stop)
    return np.where(packed, np.maximum(ends, np.arange(1, n + 1)), np.arange(1, n + 1)), packed


def pack_sequence(items: DataFrame, limits: PackLimits, block: int = 50_000, fan: int = 1000) -> DataFrame:
    """items (entry_id, position, prepared, bytes) packed as pack() does, all as one sequence in order of position and id.

    Where the next batch starts depends on where a batch starts alone, and lies at most limits.count
    items on.  So a block of consecutive items, with as many of the next one, is a function from the
    few offsets at which a batch may enter it to the offset at which one enters the next block, and
    the batches between.  These functions are composed in a tree, fan at a time; on the way back each
    block gets the one offset that is true, and numbers its items.  No task holds more than a block
    or fan functions."""
    spark, block = items.sparkSession, max(block, limits.count)
    rows = items.select("entry_id", "position", F.coalesce("prepared", F.lit(False)).alias("prepared"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"))
    rows = written(numbered(rows, [F.col("position").asc_nulls_first(), F.col("entry_id").asc_nulls_first()], name="_i", first=0), "sequence")
    own = F.floor(F.col("_i") / block)
    ahead = rows.where((F.col("_i") % block < limits.count) & (F.col("_i") >= block))
    dealt = rows.withColumn("_node", own).unionByName(ahead.withColumn("_node", own - 1))
    nodes = -(-(rows.agg(F.max("_i")).first()[0] or 0) // block) + 1

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        node = int(pdf["_node"].iloc[0])
        m = int((pdf["_i"] < (node + 1) * block).sum())
        starts, _ = _next_starts(pdf["prepared"].to_numpy(), pdf["bytes"].to_numpy(), limits)
        after, steps = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        for i in range(m - 1, -1, -1):
            j = int(starts[i])
            after[i], steps[i] = (j - m, 1) if j >= m else (after[j], steps[j] + 1)
        few = min(m, limits.count + 1)
        return pd.DataFrame({"_node": node, "entry": np.arange(few), "after": after[:few], "steps": steps[:few]})

    def table(pdf: pd.DataFrame) -> dict[int, dict[int, tuple[int, int]]]:
        out: dict[int, dict[int, tuple[int, int]]] = {}
        for node, entry, after, steps in zip(*(pdf[c].tolist() for c in ("_node", "entry", "after", "steps"))):
            out.setdefault(node, {})[entry] = after, steps
        return dict(sorted(out.items()))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        known, found = table(pdf), []
        for entry in next(iter(known.values())):
            at, total = entry, 0
            for step in known.values():
                if at not in step:  # beyond the last item
                    break
                at, total = step[at][0], total + step[at][1]
            found.append((int(pdf["_above"].iloc[0]), entry, at, total))
        return pd.DataFrame(found, columns=["_node", "entry", "after", "steps"])

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        at, total, found = int(pdf["start"].iloc[0]), int(pdf["before"].iloc[0]), []
        for node, step in table(pdf).items():
            found.append((node, at, total))
            if at in step:
                at, total = step[at][0], total + step[at][1]
        return pd.DataFrame(found, columns=["_node", "start", "before"])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        m = int((pdf["_i"] < (int(pdf["_node"].iloc[0]) + 1) * block).sum())
        starts, packed = _next_starts(pdf["prepared"].to_numpy(), pdf["bytes"].to_numpy(), limits)
        begins, i = np.zeros(m, dtype=np.int64), int(pdf["start"].iloc[0])
        while i < m:
            begins[i], i = 1, int(starts[i])
        out = pdf.iloc[:m]
        outcome = np.where(packed[:m], "packed", np.where(out["prepared"], "too_large", "unprepared"))
        return out[["entry_id", "position"]].assign(batch_no=int(pdf["before"].iloc[0]) + np.cumsum(begins), outcome=outcome)

    function = "_node long, entry long, after long, steps long"
    levels = [written(dealt.groupBy("_node").applyInPandas(exits, function), "functions")]
    above = F.floor(F.col("_node") / fan).alias("_above")
    while nodes > 1:
        levels.append(written(levels[-1].select("*", above).groupBy("_above").applyInPandas(compose, function), "functions"))
        nodes = -(-nodes // fan)
    true = spark.range(1).select(F.col("id").alias("_node"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("before"))
    for level in reversed(levels[:-1]):
        joined = level.select("*", above).join(true.withColumnRenamed("_node", "_above"), "_above")
        true = written(joined.groupBy("_above").applyInPandas(descend, "_node long, start long, before long"), "offsets")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return dealt.join(true, "_node").groupBy("_node").applyInPandas(number, f"entry_id {kinds['entry_id']}, position {kinds['position']}, batch_no long, outcome string")


def sequence_outcomes(batches: DataFrame) -> DataFrame:
    """Per item (batch_no, outcome, limited, answered): described, failed or rate_limited.

    From the first batch of all that the service limits on, no batch is sent."""
    first = batches.where("limited").agg(F.min("batch_no").alias("_first"))
    reached = F.coalesce(F.col("batch_no") >= F.col("_first"), F.lit(False))
    status = F.when(reached, "rate_limited").when((F.col("outcome") == "packed") & F.col("answered"), "described").otherwise("failed")
    return batches.join(F.broadcast(first)).withColumn("status", status).drop("_first")  # one row


def call_outcomes(batches: DataFrame) -> DataFrame:
    """Per item (shard, position, batch_no, outcome, limited, answered): described, failed or rate_limited.

    From the first batch that the service limits on, all items of the shard are rate-limited."""
    first = F.min(F.when(F.col("limited"), F.col("batch_no"))).over(Window.partitionBy("shard"))
    return batches.withColumn("status", F.when(F.col("batch_no") >= first, "rate_limited").when((F.col("outcome") == "packed") & F.col("answered"), "described").otherwise("failed"))


def _is(kind: str, value: Column) -> Column:
    """Whether a variant is of a JSON kind."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def parse_responses(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """responses (batch_no, text): JSON items as a list or a map from id to description, bare or under
    results; (batch_no, entry_id, description) of the ids expected, the first of each.

    A description is a JSON object, as text; an item without one (or with null) that has content and
    context, null ones too, is described by them.  JSON kinds are told apart: a text that looks like
    an object is none.  Left out are items that are no objects or whose description is none, ids
    that are no texts, and responses that are no JSON or name a key twice."""
    parsed = responses.select("batch_no", F.try_parse_json("text").alias("all"))
    fields = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
    named = F.coalesce(F.map_contains_key(fields(F.col("all")), "results"), F.lit(False))
    parsed = parsed.select("batch_no", F.when(named, F.try_element_at(fields(F.col("all")), F.lit("results"))).otherwise(F.col("all")).alias("items"))
    listed = F.transform(F.try_variant_get("items", "$", "array<variant>"), lambda x: F.named_struct(F.lit("id"), F.lit(None).cast("string"), F.lit("item"), x))
    mapped = F.transform(F.map_entries(fields(F.col("items"))), lambda x: F.named_struct(F.lit("id"), x["key"], F.lit("item"), x["value"]))
    rows = parsed.select("batch_no", F.posexplode(F.when(_is("ARRAY", F.col("items")), listed).otherwise(mapped)).alias("k", "x")).select("batch_no", "k", "x.id", "x.item")
    rows = rows.withColumn("own", F.when(F.col("id").isNull(), fields(F.col("item"))))
    part = lambda name: F.try_element_at("own", F.lit(name))
    told = F.when(F.col("id").isNotNull(), F.col("item")).otherwise(part("description"))
    both = F.map_contains_key("own", "content") & F.map_contains_key("own", "context") & (told.isNull() | F.is_variant_null(told))
    joined = F.concat(F.lit('{"content":'), F.to_json(part("content")), F.lit(',"context":'), F.to_json(part("context")), F.lit("}"))
    said = F.when(_is("OBJECT", told), F.to_json(told)).when(both, joined)
    ident = F.coalesce("id", F.when(_is("STRING", part("entry_id")), F.try_variant_get(part("entry_id"), "$", "string")))
    rows = rows.select("batch_no", "k", ident.alias("entry_id"), said.alias("description")).where("description is not null")
    rows = rows.join(expected.select("batch_no", "entry_id").distinct(), ["batch_no", "entry_id"], "left_semi")
    w = Window.partitionBy("batch_no", "entry_id").orderBy("k")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("batch_no", "entry_id", "description")


#: What a description without a model says, besides its summary; lists are empty.
DUMMY_SUMMARY = "Dummy batch description for "
DUMMY_CONTENT = {"summary": None, "objects": [], "text": "", "vibe": [], "background": "", "detailed_description": "Generated locally to validate batch processing.", "miscellaneous": ""}
DUMMY_CONTEXT = {"primary_category": "", "intent": "", "composition": "", "estimated_date": "", "event": "Dummy validation run", "analysis": "No Gemini request was made.", "metadata_relevance": "", "other_details": ""}


def dummy_description(entry_id: Column, file_name: Column) -> Column:
    """A description without a model, for tests and dry runs; entries without a name go by their id."""
    summary = F.concat(F.lit(DUMMY_SUMMARY), F.coalesce(F.nullif(file_name, F.lit("")), entry_id))
    value = lambda x: summary if x is None else F.array().cast("array<string>") if x == [] else F.lit(x)
    part = lambda fields: F.struct(*(value(x).alias(k) for k, x in fields.items()))
    return F.struct(part(DUMMY_CONTENT).alias("content"), part(DUMMY_CONTEXT).alias("context"))


def annotate_rigor(entries: DataFrame, rigor: str, column: str = "description") -> DataFrame:
    """entries whose description tells the rigor it was made with; other fields of its generation stay."""
    kind = entries.schema[column].dataType
    others = [n for n in kind["generation"].dataType.names if n != "rigor"] if "generation" in kind.names else []
    generation = F.struct(*(F.col(f"{column}.generation.{n}") for n in others), known_rigor(F.lit(rigor)).alias("rigor"))
    return entries.withColumn(column, F.struct(*(F.col(f"{column}.{n}") for n in kind.names if n != "generation"), generation.alias("generation")))


def prepare(files: DataFrame, api: str, model: str) -> DataFrame:
    """files with their entry id, the model's columns and no description yet."""
    return files.withColumns({"entry_id": entry_id(F.col("file_hash"), api, model), "model_hash": F.lit(model_hash(api, model)), "api_name": F.lit(api), "model_name": F.lit(model), "described": F.lit(False)})


def update_metadata(existing: DataFrame, fresh: DataFrame, columns: list[str], kept: tuple[str, ...] = ("api_name", "model_name")) -> DataFrame:
    """existing rows with the columns of fresh ones of the same file_hash; kept columns stay where they are set."""
    e, f = existing.alias("e"), fresh.alias("f")
    value = lambda c: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit("")), F.col(f"f.{c}")) if c in kept else F.col(f"f.{c}") if c in columns else F.col(f"e.{c}")
    return e.join(f, F.col("e.file_hash") == F.col("f.file_hash")).select(*(value(c).alias(c) for c in existing.columns))


def ingest_status(entries: DataFrame, update: bool = False) -> DataFrame:
    """What an ingest does with each entry: describe, index or nothing."""
    todo = F.when(~has_description(), "describe").when(F.lit(update) | indexed_at().isNull(), "index").otherwise("complete")
    return entries.select("entry_id", has_description().alias("described"), indexed_at().isNotNull().alias("indexed"), fully_indexed().alias("complete"), todo.alias("todo"))
