"""File scans: folders and path lists as metadata rows."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import base_name, compatible, extension, media_type, mime_type
from .shared import locate, remove

#: Names, or bytes of contents, that a task holds at once; one larger file is held whole where its content is asked.
NAMES, BYTES = 10_000, 8 << 20


def _walk(folder: str) -> Iterator[str]:
    """The files below a folder that Spark's readers take too, one by one."""
    with os.scandir(folder) as found:
        for x in found:
            hidden = x.name.startswith(".") or x.name.startswith("_") and "=" not in x.name or x.name.endswith("._COPYING_")
            if x.is_dir():
                if not hidden or x.name.startswith(("_metadata", "_common_metadata")):
                    yield from _walk(x.path)
            elif not hidden and (not x.is_symlink() or os.path.exists(x.path)):
                yield x.path


def _listed(spark: SparkSession, root: str) -> DataFrame | None:
    """The files' names, by a task that holds few of them, dealt to those that are to read; None where root is no folder that tasks can list."""
    path, fs = locate(spark, root)
    if fs.getUri().getScheme() != "file" or not fs.isDirectory(path):
        return None
    top = path.toUri().getPath()

    def names(batches):
        for _ in (row for b in batches for row in b.to_pylist()):
            some = []
            for x in _walk(top):
                some.append(x)
                if len(some) == NAMES:
                    yield pa.RecordBatch.from_pydict({"path": some})
                    some = []
            yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string())})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spark.range(0, 1, 1, 1).mapInArrow(names, "path string").repartition(tasks, "path")


def scan_folder(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Every file below root that is not empty: path, modificationTime, length and content, or in its place its file_hash, for which files are read piece by piece.

    Tasks list and read shared folders.  Other stores, which only Spark reads, are listed by Spark,
    on the driver; there the content is read where a column needs it."""
    listed = _listed(spark, root)
    if listed is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return files if content else files.withColumn("file_hash", F.sha2("content", 256)).drop("content")
    last, kind = ("content", pa.binary()) if content else ("file_hash", pa.string())
    schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), (last, kind)])

    def rows(paths):
        for path in paths:
            with open(path, "rb") as f:
                told = os.fstat(f.fileno())
                if told.st_size:
                    yield f"file:{path}", told.st_mtime_ns // 1_000_000 * 1000, told.st_size, f.read() if content else hashlib.file_digest(f, "sha256").hexdigest()

    def read(batches):
        some, held = [], 0
        for row in rows(x for b in batches for x in b.column(0).to_pylist()):
            some.append(row)
            held += row[2] if content else 0
            if len(some) == NAMES or held >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), schema.types)], schema=schema)
                some, held = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), schema.types)], schema=schema)

    return listed.mapInArrow(read, f"path string, modificationTime timestamp, length long, {last} {'binary' if content else 'string'}")


def remove_folder(spark: SparkSession, root: str) -> None:
    """Deletes a folder; tasks delete its files, so the driver never holds their list."""
    if (listed := _listed(spark, root)) is not None:

        def unlink(batches):
            for b in batches:
                for path in b.column(0).to_pylist():
                    try:
                        os.unlink(path)
                    except FileNotFoundError:  # by an attempt before
                        pass
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        listed.mapInArrow(unlink, "n long").agg(F.sum("n")).collect()
    remove(spark, root)


def scan_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files listed, with their position; a later path wins where contents are equal (catalog.last_wins)."""
    order = spark.createDataFrame(list(enumerate(paths)), "position long, wanted string")
    files = spark.read.format("binaryFile").load(paths).withColumn("wanted", F.regexp_replace("path", "^file:/+", "/"))
    return files.join(order, "wanted").drop("wanted")


def file_metadata(files: DataFrame) -> DataFrame:
    """Hash (of the content, where it is not there), name, kind and MIME type of scanned files.  Spark tells no creation time, only the last change."""
    path = F.regexp_replace("path", "^file:/+", "/")
    digest = F.col("file_hash") if "file_hash" in files.columns else F.sha2("content", 256)
    out = files.withColumns({"file_hash": digest, "file_path": path, "file_name": base_name(path)})
    out = out.withColumn("ext", extension(F.col("file_name"))).withColumn("media_type", media_type(F.col("ext")))
    changed = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return out.withColumns({"mime_type": mime_type(F.col("ext"), F.col("media_type")), "is_compat": compatible(F.col("ext")), "modification_date": changed}).drop("content")
