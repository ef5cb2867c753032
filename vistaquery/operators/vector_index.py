"""An inverted-file index of vectors: lists by the nearest of some centroids, one folder each.

The centroids are fitted by k-means on a sample of at most SAMPLE vectors; every vector is put into
the list of its centroid.  A search reads the lists whose centroids are nearest to its queries, by
literals, so that Spark prunes the other folders, and ranks what is in them exactly.  exact reads
all lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import QuerySpec
from ..sources.shared import new_folder, written
from . import ranking

#: Vectors that centroids are fitted on at most, vectors that a list is to hold about, and lists that a query reads.
SAMPLE, PER_LIST, MAX_LISTS, PROBES = 20_000, 5_000, 4_096, 8


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    schema: T.StructType
    centroids: np.ndarray  # MAX_LISTS at most

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("list", T.IntegerType())])).parquet(self.folder)

    def lists_of(self, vector: tuple[float, ...], probes: int) -> list[int]:
        """Of the centroids nearest by cosine; vectors of another length than theirs are in list 0."""
        x = np.asarray(vector, dtype=np.float64)
        if self.centroids.shape[1] != len(x):
            return [0]
        near = self.centroids @ x / np.maximum(np.linalg.norm(self.centroids, axis=1) * np.linalg.norm(x), 1e-300)
        return np.argsort(-near, kind="stable")[:probes].tolist()

    def scan(self, queries: list[QuerySpec], probes: int = PROBES, exact: bool = False) -> DataFrame:
        """The rows of the lists that any of the queries reads."""
        wanted = sorted({x for q in queries if q.vector for x in self.lists_of(q.vector, probes)})
        return (self.rows() if exact else self.rows().where(F.col("list").isin(wanted))).drop("list")

    def rank(self, queries: list[QuerySpec], n: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """As ranking.semantic_rank, which it is over all rows if exact."""
        return ranking.semantic_rank(self.scan(queries, probes, exact), queries, n)


def build_vector_index(vectors: DataFrame, folder: str | None = None, per_list: int = PER_LIST, seed: int = 11) -> VectorIndex:
    """Writes the index of vectors (collection, entry_id, embedding); vectors that have no direction (null, zero, null or
    non-finite components) are found by no query and left out, those of another length than most are in list 0."""
    spark = vectors.sparkSession
    folder = folder or f"{new_folder(spark, 'vectors')}/lists"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = written(vectors.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)), "vectors")  # counting, fitting and placing read it
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        rows.withColumn("list", F.lit(0)).write.partitionBy("list").parquet(folder)
        return VectorIndex(spark, folder, vectors.schema, np.zeros((1, 1)))
    dim, n = sizes[0]
    as_vector = array_to_vector(F.col("embedding").cast("array<double>"))
    fitting = rows.where(F.size("embedding") == dim).sample(min(1.0, SAMPLE / n), seed=seed).limit(SAMPLE).select(as_vector.alias("features"))
    lists = max(1, min(-(-n // per_list), MAX_LISTS))
    model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(fitting) if lists > 1 else None
    centroids = np.array(model.clusterCenters()) if model else np.ones((1, dim))
    if model:
        placed = model.transform(rows.where(F.size("embedding") == dim).withColumn("features", as_vector)).withColumnRenamed("prediction", "list").drop("features")
        placed = placed.unionByName(rows.where(F.size("embedding") != dim).withColumn("list", F.lit(0)))
    else:
        placed = rows.withColumn("list", F.lit(0))
    placed.hint("rebalance", "list").write.partitionBy("list").parquet(folder)
    return VectorIndex(spark, folder, vectors.schema, centroids)
