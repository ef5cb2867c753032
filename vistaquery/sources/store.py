"""Keyed tables in folders by hash bucket, of which a change rewrites those that it touches.

The bucket comes from a key's first part, so that rows whose id is an entry's id with something
after it lie with their entry.  A change reads the touched buckets alone (their numbers are
literals, so the scan is pruned to their folders), and replaces them by dynamic partition
overwrite, whose files are staged and moved when the job is done: rows are read from the folders
that they replace, and other folders keep their files.  A bucket that a change empties is removed
after it.  Deletions and marks send their ids to where the rows are read, so rows that stay go
through no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog
from .shared import new_folder, remove

#: Folders of a store; for larger tables choose more, as a change of a few keys rewrites a folder for each.
BUCKETS = 1024
#: Ids that are broadcast at once (21 MB), and how often a change does so; those beyond meet their rows by shuffle.
IDS, BATCHES = 200_000, 16


def entry_part(key: Column) -> Column:
    """The entry's id, with which ids of its parts begin."""
    return F.substring(key, 1, catalog.ENTRY_ID_LENGTH)


def batched(counts: dict[int, int]) -> tuple[list[list[int]], list[int]]:
    """Buckets in batches that hold at most IDS ids each, at most BATCHES of them, and the other buckets."""
    batches, held, rest = [], 0, []
    for bucket, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        if batches and held + n <= IDS:
            batches[-1].append(bucket)
            held += n
        elif n <= IDS and len(batches) < BATCHES:
            batches.append([bucket])
            held = n
        else:
            rest.append(bucket)
    return batches, rest


@dataclass(frozen=True)
class BucketedStore:
    """Rows of a schema by keys, at path; the first key names the entry."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...] = ("entry_id",)
    buckets: int = BUCKETS

    def _bucketed(self, rows: DataFrame, key: Column) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(entry_part(key)), F.lit(self.buckets)).cast("int"))

    def _read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._read().drop("bucket")

    def lookup(self, ids: DataFrame, *columns: Column) -> DataFrame:
        """The rows whose first key is among ids (entry_id), with all their columns or those given beside that key; only their buckets are read."""
        named = ids.select(F.col("entry_id").alias(self.keys[0])).distinct()
        touched = self._touched(self._bucketed(named, F.col(self.keys[0])))
        rows = self._read().where(F.col("bucket").isin(touched)).drop("bucket")
        return (rows.select(self.keys[0], *columns) if columns else rows).join(named, self.keys[0], "left_semi")

    def lookup_entries(self, ids: DataFrame) -> DataFrame:
        """The rows that belong to entries (entry_id): whose first key begins with their id."""
        named = ids.select(F.col("entry_id").alias("_entry")).distinct()
        touched = self._touched(self._bucketed(named, F.col("_entry")))
        rows = self._read().where(F.col("bucket").isin(touched)).drop("bucket").withColumn("_entry", entry_part(F.col(self.keys[0])))
        return rows.join(named, "_entry", "left_semi").drop("_entry")

    def create(self, rows: DataFrame) -> None:
        self._write(self._dealt(self._bucketed(rows.select(*self.schema.names), F.col(self.keys[0]))), "errorifexists")

    def upsert(self, new: DataFrame) -> list[int]:
        """Columns of new replace those of rows with their keys, others are added; which buckets were rewritten."""
        rows = self._bucketed(new, F.col(self.keys[0]))
        full = rows.select("bucket", *(F.col(c) if c in new.columns else F.lit(None).cast(f.dataType).alias(c) for c, f in ((f.name, f) for f in self.schema.fields)))
        if len(self.keys) == 1:
            return self._replace(rows, lambda old: catalog.upsert(old, full, self.keys[0]))
        return self._replace(rows, lambda old: catalog.upsert_rows(old, full, list(self.keys)))

    def mark_indexed(self, ids: DataFrame, at: Column) -> list[int]:
        return self._change(ids, lambda old, some: catalog.mark_indexed(old, some, at))

    def delete(self, ids: DataFrame) -> list[int]:
        """Rows go whose first key is one of ids (entry_id), or begins with one and an underscore."""
        return self._change(ids, lambda old, some: catalog.delete_prefixed(old.withColumnRenamed(self.keys[0], "id"), some).withColumnRenamed("id", self.keys[0]))

    def _touched(self, rows: DataFrame) -> list[int]:
        """At most the set number of buckets."""
        return sorted(r[0] for r in rows.select("bucket").where("bucket is not null").distinct().collect())

    def _replace(self, named: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        touched = self._touched(named)
        if touched:
            self._overwrite(touched, lambda old: self._dealt(change(old)))
        return touched

    def _change(self, ids: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """change makes the new rows from those of some buckets and the ids there; rows keep the order of their files, so none are dealt anew."""
        named = self._bucketed(ids.select("entry_id"), F.col("entry_id"))
        counts = dict(named.where("bucket is not null").groupBy("bucket").count().collect())
        batches, rest = batched(counts)
        folder = None
        if len(batches) + bool(rest) > 1:  # ids may come from the store, which the first batch changes
            folder = new_folder(self.spark, "ids")
            named.write.parquet(f"{folder}/rows")
            named = self.spark.read.schema(named.schema).parquet(f"{folder}/rows")
        there = lambda buckets: named.where(F.col("bucket").isin(buckets)).select("entry_id")
        for buckets in batches:
            self._overwrite(buckets, lambda old: change(old, F.broadcast(there(buckets))))  # noqa: B023
        if rest:
            self._overwrite(rest, lambda old: self._dealt(change(old, there(rest))))
        if folder:
            remove(self.spark, folder)
        return sorted(counts)

    def _overwrite(self, buckets: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        before = self._files(buckets)
        self._write(change(self._read().where(F.col("bucket").isin(buckets))), "overwrite")
        for bucket in {b for b, _ in before & self._files(buckets)}:  # overwriting by no rows leaves the old files
            remove(self.spark, f"{self.path}/bucket={bucket}")

    def _files(self, buckets: list[int]) -> set[tuple[int, str]]:
        rows = self._read().where(F.col("bucket").isin(buckets)).select("bucket", "_metadata.file_path").distinct()
        return {(r[0], r[1]) for r in rows.collect()}

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """A bucket is one task's, but where it is large."""
        return rows.hint("rebalance", "bucket")

    def _write(self, rows: DataFrame, mode: str) -> None:
        ordered = rows.sortWithinPartitions("bucket", *self.keys)
        ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
