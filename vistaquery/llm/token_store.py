"""Token-ID output: Parquet list columns in doc_id order, for selective reads.

Files hold one row per document: doc_id, file_no, start_in_file, n_tokens and tokens (a list
of 32-bit ids).  Ids are dictionary-encoded (or delta, by choice), counts and positions are
delta-encoded; row groups hold a set number of ids and every column chunk has a page index,
so a read of some documents, or of the metadata alone, skips the pages of all other ids.
A side table `index` has one row per file with the ids before it and the name of the task
attempt that wrote it, which is in every row of the file too: files of other attempts, even
late ones, join with no row of it.

Null text: empty, so the end id alone.  Null doc_id: before all others.  Equal doc_ids: in
order of a hash of their texts, then of the texts.  Equal rows: any order.  Empty table: no
files.  A text of any length is one row.  Further columns are not stored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder
from .work import BATCH_ROWS, batch_rows, give_back, locate, part_tables, work_dir

#: Ids in a row group, and bytes in a data page.
GROUP_IDS, PAGE_BYTES = 1 << 20, 1 << 17
#: Bytes of text for a file, unless the session asks for more partitions than that makes files.
FILE_BYTES = 64 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("file_no", pa.int32()), ("attempt", pa.string()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
#: Texts that are encoded at a time, in bytes.
BATCH_BYTES = 2 << 20


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """flat ids with end_id after each text's ids; the new counts."""
    out = np.full(len(flat) + len(counts), end_id, dtype=np.int32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
    return out, counts + 1


def list_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and the offsets of its rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def crc32_of(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The crc32 of each list of ids, as little-endian unsigned 32-bit integers; ends: 0 and where each list ends in flat."""
    raw, at = memoryview(flat.astype("<u4").tobytes()), ends.tolist()
    return pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at, at[1:])], pa.int64())


def crc32_of_lists(batches):
    """For mapInArrow: the last column, lists of ids, becomes its crc32."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], crc32_of(*list_values(b.column(b.num_columns - 1)))], names=[*b.schema.names[:-1], "ids_crc32"])


@dataclass(frozen=True)
class TokenStore:
    """Where the files are; reads go through Spark, so any part of them is read alone."""

    folder: str

    def read(self, spark: SparkSession, *columns: str) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens and tokens, or those of them that are named."""
        index = spark.read.schema("file_no int, attempt string, base long").parquet(f"{self.folder}/index")
        rows = spark.read.schema("doc_id long, file_no int, attempt string, start_in_file long, n_tokens long, tokens array<int>").parquet(f"{self.folder}/files")
        rows = rows.join(F.broadcast(index), ["file_no", "attempt"]).withColumn("start", F.col("base") + F.col("start_in_file"))  # a row of index per file
        return rows.select(*(columns or ("doc_id", "start", "n_tokens", "tokens")))


def write_token_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, encoding: str = "dictionary", group_ids: int = GROUP_IDS) -> TokenStore:
    """Encodes every whole text and writes the store in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    fs, path = locate(f"{folder}/files")
    fs.create_dir(path, recursive=True)
    choice = {"use_dictionary": ["attempt", *(["tokens.list.element"] if encoding == "dictionary" else [])]}
    delta = {c: "DELTA_BINARY_PACKED" for c in ("doc_id", "file_no", "start_in_file", "n_tokens", *(["tokens.list.element"] if encoding == "delta" else []))}

    def run(batches):
        file_no, docs_here, ids_here, held, held_ids, out, attempt = TaskContext.get().partitionId(), 0, 0, [], 0, None, ""
        tool = encoder(tokenizer)

        def flush():
            nonlocal held, held_ids
            if held:
                t = pa.concat_tables(held)
                out.write_table(t, row_group_size=t.num_rows)
                held, held_ids = [], 0

        sink = None
        for t in part_tables(batches, BATCH_BYTES):
            if out is None:
                attempt = uuid.uuid4().hex
                uri = f"{folder}/files/ids-{attempt}.parquet"
                where, p = locate(uri)
                sink = where.open_output_stream(p)
                out = pq.ParquetWriter(sink, SCHEMA, compression="zstd", compression_level=1, column_encoding=delta, write_page_index=True, data_page_size=PAGE_BYTES, dictionary_pagesize_limit=4 << 20, **choice)
            flat, counts = with_end(*tool.encode(t["text"].to_pylist()), end_id)
            starts = ids_here + np.cumsum(counts) - counts
            table = pa.table([t["doc_id"].combine_chunks(), pa.array(np.full(len(counts), file_no), pa.int32()), pa.array([attempt] * len(counts), pa.string()), pa.array(starts), pa.array(counts), list_column(flat, counts)], schema=SCHEMA)
            at = 0
            while at < len(counts):  # a row group is closed at the document that fills it
                room = np.searchsorted(np.cumsum(counts[at:]), group_ids - held_ids) + 1
                held.append(table.slice(at, int(room)))
                held_ids += int(counts[at : at + room].sum())
                at += int(room)
                if held_ids >= group_ids:
                    flush()
            docs_here, ids_here = docs_here + len(counts), ids_here + int(counts.sum())
        if out is not None:
            flush()
            out.close()
            sink.close()
            give_back()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([file_no], pa.int32()), "attempt": [attempt], "docs": [docs_here], "ids": [ids_here]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # equal doc_ids may go apart, by their texts' hash, so that no id's rows need one task
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))
    ranged = texts.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first())
    with batch_rows(spark, BATCH_ROWS):
        made = sorted(ranged.mapInArrow(run, "file_no int, attempt string, docs long, ids long").collect(), key=lambda r: r.file_no)  # a row per file
    base = np.cumsum([0, *(r.ids for r in made)]).tolist()
    spark.createDataFrame([(r.file_no, r.attempt, b) for r, b in zip(made, base)], "file_no int, attempt string, base long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")
    return TokenStore(folder)
