"""Connected components of an edge table, by alternating large-star and small-star steps.

Every task first keeps only a spanning forest of the edges it reads.  Then each round maps
every neighbour of a node to the smallest one; rounds go on until no edge changes, each cut
off by a written table.  No node's edges need be in one task: the smallest neighbour is a
partially aggregated minimum, and the join that follows may be split by Spark where it is
skewed.  Only the count and a checksum of the edges reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import remove, work_dir


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: its other nodes, and its smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        new = new[label] if len(new) else new
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _forests(limit: int):
    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in batches:
            a = np.concatenate([a, x.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, x.column(1).to_numpy(zero_copy_only=False)])
            if len(a) > limit:
                a, b = forest(a, b)
                if len(a) > limit // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])
                    a = b = np.zeros(0, np.int64)
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return run


def components(edges: DataFrame, limit: int = 1 << 21) -> DataFrame:
    """(node, component) for each node of edges (two long columns); component is its smallest node."""
    spark = edges.sparkSession
    folder = work_dir(spark, "components")
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").mapInArrow(_forests(limit), "u long, v long").distinct()
    before, k = None, 0
    while True:
        e.write.parquet(f"{folder}/round{k}")
        e = spark.read.schema("u long, v long").parquet(f"{folder}/round{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if k:
            remove(f"{folder}/round{k - 1}")
        if now == before or not now[0]:
            break
        before, k = now, k + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
