"""Shared-folder work area: staged part files, and arrays that Spark shuffles as binary rows.

Multi-pass operators read their documents once and stage them as part files of a set size in
the shared folder.  Every task attempt writes files of its own name; the names themselves are
rows of a table that Spark commits, so only files of finished tasks are ever read, a pass that
is retried after an executor was lost reads the same rows in the same order, and no list of
files is on the driver or in a task's closure.  Parts exchange arrays through Spark's own
shuffle: one row for each part and bucket that have something in common, never more rows than
entries.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw bytes of Arrow data that one staged part holds before the next one is begun.
PART_BYTES = 8 << 20
#: Rows of long texts that Spark and a Python worker exchange at a time.
BATCH_ROWS = 1000
#: Staged bytes beyond which shuffle files are freed between the passes of an operator.
FREE_BYTES = 32 << 20
_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset, and Spark runs in one machine (as in tests), a temporary
    folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="work-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared root; it goes when the driver's process ends."""
    out = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(lambda: [remove(x) for x in _MADE])
    _MADE.append(out)
    fs, path = locate(out)
    fs.create_dir(path, recursive=True)
    return out


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def remove(uri: str) -> None:
    fs, path = locate(uri)
    try:
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)
        else:
            fs.delete_file(path)
    except OSError:
        pass


def new_name(folder: str, kind: str) -> str:
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def write_parquet(uri: str, table: pa.Table, **options) -> None:
    fs, path = locate(uri)
    with fs.open_output_stream(path) as out:
        pq.write_table(table, out, **({"compression": "zstd", "compression_level": 1} | options))


def read_parquet(uri: str, columns: list[str] | None = None) -> pa.Table:
    fs, path = locate(uri)
    with fs.open_input_file(path) as f:
        return pq.read_table(f, columns=columns)


#: What a worker may drop that it remembers between tasks; modules with such a memory add to it.
REMEMBERED: list[Callable[[], None]] = []


def give_back(forget: bool = False) -> None:
    """Hands memory that is free back to the system, as Python workers live on between tasks;
    forget: and what was remembered for speed."""
    if forget:
        for drop in REMEMBERED:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def part_tables(batches: Iterator[pa.RecordBatch], limit: int = PART_BYTES) -> Iterator[pa.Table]:
    """The batches, gathered to tables of about limit bytes."""
    held, size = [], 0
    for b in batches:
        step = max(1, int(b.num_rows * limit / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            held.append(b.slice(i, step))
            size += held[-1].nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Within it, Arrow batches have n rows at most; the session's own setting comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(n, int(old)) if int(old) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


PARTS = "part string, rows long, bytes long"


@dataclass(frozen=True)
class Staged:
    """Part files of a table; the table `label` in the same folder has a row for each."""

    spark: SparkSession
    folder: str
    label: str
    n: int
    rows: int
    bytes: int

    def __reduce__(self):
        """Tasks get it without the session."""
        return Staged, (None, self.folder, self.label, self.n, self.rows, self.bytes)

    def parts(self) -> DataFrame:
        return self.spark.read.schema(PARTS).parquet(f"{self.folder}/{self.label}")

    def each(self, run: Callable[[str], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """run(part) for every part."""

        def every(batches):
            give_back(forget=True)
            for b in batches:
                for part in b.column(0).to_pylist():
                    yield from run(part)
                    give_back()

        return self.parts().repartition(max(self.n, 1), "part").mapInArrow(every, schema)

    def read(self, part: str, columns: list[str] | None = None) -> pa.Table:
        return read_parquet(f"{self.folder}/{part}", columns)

    def remove(self) -> None:
        """The files go, their rows are lost."""
        fs, path = locate(self.folder)
        for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith(f"{self.label}.") or info.base_name == self.label:
                remove(f"{self.folder}/{info.base_name}")


def stage(df: DataFrame, folder: str, label: str = "docs", order: list[str] | None = None, limit: int = PART_BYTES) -> Staged:
    """Writes df as part files in folder; order: columns by which the rows of a part are sorted, nulls first."""

    def run(batches):
        give_back(forget=True)
        for t in part_tables(batches, limit):
            if order:
                t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
            t = t.combine_chunks()
            part = f"{label}.{uuid.uuid4().hex}"
            write_parquet(f"{folder}/{part}", t)
            yield pa.RecordBatch.from_pydict({"part": [part], "rows": [t.num_rows], "bytes": [t.nbytes]})
            give_back()

    with batch_rows(df.sparkSession, BATCH_ROWS):
        df.mapInArrow(run, PARTS).write.parquet(f"{folder}/{label}")
    parts = df.sparkSession.read.schema(PARTS).parquet(f"{folder}/{label}")
    n, rows, size = parts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return Staged(df.sparkSession, folder, label, n, rows, size)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte plane by byte plane."""
    out, codec = [], pa.Codec("zstd", compression_level=1)
    for x in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
        z = codec.compress(raw, asbytes=True) if raw else b""
        out += [len(raw).to_bytes(8, "little"), len(z).to_bytes(8, "little"), z]
    return b"".join(out)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    """What pack() was given; kinds: the arrays' dtypes."""
    out, at, codec = [], 0, pa.Codec("zstd")
    for kind in kinds:
        size, z = int.from_bytes(blob[at : at + 8], "little"), int.from_bytes(blob[at + 8 : at + 16], "little")
        raw = codec.decompress(blob[at + 16 : at + 16 + z], size, asbytes=True) if size else b""
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(wide, -1).T).reshape(-1).view(kind))
        at += 16 + z
    return out


def put_parquet(uri: str, table: pa.Table, **options) -> None:
    """Writes a file of a fixed name; attempts that write the same rows replace one another as a whole."""
    own = f"{uri}.{uuid.uuid4().hex}"
    write_parquet(own, table, **options)
    fs, path = locate(own)
    fs.move(path, locate(uri)[1])


def free_shuffles(staged: Staged) -> None:
    """Spark drops the shuffle files of jobs that are over when their plans are garbage: asks for that now, where it is worth a pause."""
    if staged.bytes > FREE_BYTES:
        free_now(staged.spark)


def free_now(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_count(size: int, each: int) -> int:
    return max(16, -(-size // each))
