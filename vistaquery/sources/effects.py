"""Files stored and deleted once, whatever attempts fail: a Spark data source with commit and abort.

Tasks only prepare: payloads are written under names of their own in a folder of the job, and what
is to be moved or deleted goes to a list there, whose name is the task's message.  When all tasks
are done the driver follows the lists of the attempts that counted; other attempts' files go with
the folder, and if the job fails nothing else has changed.  Moves and deletions can be repeated,
so an interrupted commit is mended by running the job again."""

from __future__ import annotations

import io
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from itertools import batched

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.media import base_name, extension
from ..operators import catalog
from .shared import written
from .store import BucketedStore


#: Moves of a list that are under way at once, and lines of it that the driver holds.
MOVERS, LINES = 16, 1000


def _locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _empty(fs: pafs.FileSystem, folder: str) -> bool:
    if not isinstance(fs, pafs.LocalFileSystem):
        return not fs.get_file_info(pafs.FileSelector(folder))
    with os.scandir(folder) as found:  # not all names of a large folder
        return next(found, None) is None


@dataclass
class Prepared(WriterCommitMessage):
    listed: str


class FileEffects(DataSource):
    """Rows (path, payload): a payload is stored at its path, null deletes the file.  Options: root, below which all paths must be."""

    @classmethod
    def name(cls) -> str:
        return "file_effects"

    def schema(self) -> str:
        return "path string, payload binary"

    def writer(self, schema, overwrite: bool) -> FileEffectsWriter:
        return FileEffectsWriter(self.options["root"])


class FileEffectsWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.folder = f"{self.root}/.pending-{uuid.uuid4().hex}"
        fs, folder = _locate(self.folder)
        fs.create_dir(folder, recursive=True)  # by the driver alone, so a task that outlives the job finds none

    def write(self, iterator: Iterator) -> Prepared:
        fs, folder = _locate(self.folder)
        base, listed = _locate(self.root)[1], f"{folder}/list-{uuid.uuid4().hex}"
        with fs.open_output_stream(listed, buffer_size=1 << 16) as todo:
            for row in iterator:
                path = _locate(row.path)[1]
                if posixpath.normpath(path) != path or not path.startswith(f"{base}/"):
                    raise ValueError(f"{row.path} is not below {self.root}")
                own = None
                if row.payload is not None:
                    own = f"{folder}/{uuid.uuid4().hex}"
                    with fs.open_output_stream(own) as out:
                        out.write(bytes(row.payload))
                todo.write(f"{json.dumps((own, path))}\n".encode())
        return Prepared(listed)

    def commit(self, messages: list[Prepared | None]) -> None:
        fs, folder = _locate(self.folder)
        with ThreadPoolExecutor(MOVERS) as pool:
            for message in filter(None, messages):
                with io.TextIOWrapper(fs.open_input_stream(message.listed), "utf-8") as lines:
                    for some in batched(lines, LINES):
                        self._follow(fs, pool, [json.loads(x) for x in some])
        self.abort(messages)

    def _follow(self, fs: pafs.FileSystem, pool: ThreadPoolExecutor, todo: list) -> None:
        moves = [(own, path) for own, path in todo if own]
        for parent in {posixpath.dirname(path) for _, path in moves}:
            fs.create_dir(parent, recursive=True)
        for _ in pool.map(lambda m: fs.move(*m), moves):  # errors are raised here
            pass
        left = set()
        for _, path in (x for x in todo if not x[0]):
            if fs.get_file_info(path).type == pafs.FileType.File:
                fs.delete_file(path)
                left.add(posixpath.dirname(path))
        for parent in left:
            self._drop_empty(fs, parent)

    def abort(self, messages: list[Prepared | None]) -> None:
        fs, folder = _locate(self.folder)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)

    def _drop_empty(self, fs: pafs.FileSystem, folder: str) -> None:
        base = _locate(self.root)[1]
        while folder.startswith(f"{base}/") and fs.get_file_info(folder).type == pafs.FileType.Directory and _empty(fs, folder):
            fs.delete_dir(folder)
            folder = posixpath.dirname(folder)


def apply_effects(rows: DataFrame, root: str) -> None:
    """rows: path and payload, or path alone to delete."""
    rows.sparkSession.dataSource.register(FileEffects)
    payload = F.col("payload") if "payload" in rows.columns else F.lit(None).cast("binary")
    rows.select("path", payload.alias("payload")).write.format("file_effects").option("root", root).mode("append").save()


def store_uploads(uploads: DataFrame, entries: DataFrame, root: str, now: datetime) -> DataFrame:
    """Stores the payloads of uploads (position, name, payload) that no entry has, once each, as root/yyyymmdd/hash.ext.

    Per hash the first upload's name, the path (of a stored entry: its own) and whether it is new."""
    hashed = uploads.where(F.length("payload") > 0).withColumn("file_hash", F.sha2("payload", 256))
    known = entries.where("metadata.file_hash is not null and metadata.file_path is not null").groupBy(F.col("metadata.file_hash").alias("file_hash")).agg(F.min("metadata.file_path").alias("there"))
    first = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("file_hash").orderBy("position"))).where("_n = 1")
    ext = extension(base_name(F.regexp_replace("name", r"\\", "/")))
    own = F.concat(F.lit(f"{root.rstrip('/')}/{now:%Y%m%d}/"), F.col("file_hash"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    found = first.join(known, "file_hash", "left").select("file_hash", "name", F.coalesce("there", own).alias("path"), F.col("there").isNull().alias("new"), F.when(F.col("there").isNull(), F.col("payload")).alias("payload"))
    listed = written(found, "uploads")  # what is stored and what is returned are the same rows
    apply_effects(listed.where("new").select("path", "payload"), root)
    return listed.drop("payload")


def delete_uploads(hashes: DataFrame, entries: BucketedStore, collections: BucketedStore | None, root: str) -> DataFrame:
    """Entries of the hashes, all that collections hold of them, and their files below root; per hash the paths and ids that went.

    What is to go is written first.  The tables change before the files: if the job ends between,
    no entry names a file that is gone, and a call with the same hashes' paths deletes the rest."""
    _, gone = catalog.delete_by_hash(entries.read(), hashes)
    listed = written(gone, "deleted")
    ids = listed.select(F.explode("ids").alias("entry_id"))
    if collections is not None:
        collections.delete(ids)
    entries.delete(ids)
    below = listed.select(F.explode("paths").alias("path")).where(F.col("path").startswith(f"{root.rstrip('/')}/")).distinct()
    apply_effects(below, root)
    return listed
