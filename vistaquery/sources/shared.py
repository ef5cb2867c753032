"""The folder that driver and executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and Spark runs in one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def locate(spark: SparkSession, path: str):
    """The path as Hadoop's, and the file system that it lies in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared root; it goes when the driver ends."""
    out = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    path, fs = locate(spark, out)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    found, fs = locate(spark, path)
    fs.delete(found, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of the shared folder."""
    path = f"{new_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
