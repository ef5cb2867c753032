"""Best-fit packing: sum-of-squares bin packing of token sequences.

A document is its ids and an end id.  One longer than the sequence length is cut into
pieces of that length, of which the first takes the rest; all others stay whole.  Full
pieces are sequences of their own.  Every other piece goes, longest first, into the open bin
for which the sum over gaps of the squared count of open bins with that gap becomes smallest
(equal: the smallest gap); a new bin is opened only where no open one holds the piece, as a
rule that opens bins for the sake of the sum leaves bins of every gap open at the end.  Pieces
are dealt to shards of a set size by a hash of their unique key, and the pieces of bins that a
shard leaves open are packed anew, in shards again, while that lessens them; so no task holds
more than a shard, whatever the data.

Null text: empty (the end id alone).  Null or repeated doc_ids are packed row by row.
Equal
lengths: by piece_key.  Empty table: no rows.  A text of any length is cut into pieces of one
row each.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoder import REMEMBER, encoder
from .token_store import BATCH_BYTES, crc32_of, list_column, with_end
from .work import BATCH_ROWS, batch_rows, give_back, part_tables, work_dir

#: Pieces in a shard.
SHARD = 1 << 17
FULL_BASE = 1 << 62


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given, and the gap left in each bin.

    Putting a piece of length s into a bin with gap g changes the sum of squares by
    2 (n[g - s] - n[g] + 1); a full bin counts nowhere."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for k, s in enumerate(lengths.tolist()):
        change = 2 * (1 - counts[s:])
        change[1:] += 2 * counts[1 : capacity + 1 - s]
        change[0] -= 1
        change[counts[s:] == 0] = 1 << 40
        gap = s + int(np.argmin(change))
        if counts[gap]:
            b = waiting[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[k], offsets[k] = b, capacity - gap
        gaps[b] = gap - s
        if gap > s:
            waiting[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets, np.array(gaps, dtype=np.int64)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, folder: str | None = None, remember: int = REMEMBER) -> DataFrame:
    """Per piece: piece_key (unique), doc_id, piece, start, length, ids_crc32, tokens; written to the shared folder and read from it."""
    spark = docs.sparkSession

    def run(batches):
        tool, key = encoder(tokenizer, remember), TaskContext.get().partitionId() << 36
        for t in part_tables(batches, BATCH_BYTES):
            flat, counts = with_end(*tool.encode(t["text"].to_pylist()), end_id)
            n = -(-counts // capacity)
            first = counts - (n - 1) * capacity
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            keys = key + np.arange(len(doc))
            key += len(doc)
            yield pa.RecordBatch.from_arrays([pa.array(keys), t["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), crc32_of(flat, np.concatenate([[0], np.cumsum(length)])), list_column(flat, length)], names=["piece_key", "doc_id", "piece", "start", "length", "ids_crc32", "tokens"])
        give_back()

    folder = f"{folder or work_dir(spark, 'pieces')}/pieces"
    schema = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long, tokens array<int>"
    with batch_rows(spark, BATCH_ROWS):
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _pack_shard(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        """A shard's items (of one or more pieces each, laid end to end): item, size -> bin, offset, and the bin's gap."""
        size = t["size"].to_numpy()
        order = np.lexsort((t["item"].to_numpy(), -size))
        bins, offsets, gaps = sum_of_squares(size[order], capacity)
        shard = t["shard"][0].as_py() if t.num_rows else 0
        return pa.table({"item": t["item"].take(pa.array(order)), "size": pa.array(size[order]), "bin": pa.array((shard << 24) + bins), "at": pa.array(offsets), "used": pa.array(capacity - gaps[bins])})

    return run


def pack_lengths(pieces: DataFrame, capacity: int, shard_size: int = SHARD, folder: str | None = None, rounds: int = 62) -> DataFrame:
    """pieces (piece_key unique, length 1 to capacity, and any other columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    folder = folder or work_dir(spark, "packing")
    small = F.col("length") < capacity
    items = pieces.where(small).select(F.col("piece_key").alias("item"), F.col("length").alias("size"))
    kept, last = None, -1
    schema = "item long, size long, bin long, at long, used long"
    for k in range(rounds):
        n = items.count()
        shards = max(1, -(-n // shard_size))
        final = shards == 1 or n == last or k == rounds - 1  # places all that is left
        last = n
        packed = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(k)), F.lit(shards))).groupBy("shard").applyInArrow(_pack_shard(capacity), schema)
        packed.write.mode("overwrite").parquet(f"{folder}/round{k}")
        packed = spark.read.schema(schema).parquet(f"{folder}/round{k}")
        if final:
            done, items = packed, None
        else:  # bins with a gap are taken apart and packed together with those of the other shards
            done = packed.where(F.col("used") == capacity)
            items = packed.where(F.col("used") < capacity).select("item", "size")
        done = done.select("item", (F.col("bin") + F.lit(k << 56)).alias("sequence_id"), F.col("at").alias("offset"))
        kept = done if kept is None else kept.unionByName(done)
        if items is None:
            break
    full = pieces.where(~small).select(*pieces.columns, (F.col("piece_key") + F.lit(FULL_BASE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(small).join(kept.withColumnRenamed("item", "piece_key"), "piece_key").select(*full.columns).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, shard_size: int = SHARD) -> DataFrame:
    """The whole operator: pieces of all documents with their ids, sequence and place."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity)
    placed = pack_lengths(pieces.drop("tokens"), capacity, shard_size)
    return placed.join(pieces.select("piece_key", "tokens"), "piece_key").drop("piece_key")
