"""Extension: folders as a stream.  New files are merged into the catalog batch by batch, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import file_metadata

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_folder(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(root)


def ingest_stream(spark: SparkSession, root: str, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs merge(metadata of the new files, batch) for all that is there, then stops; a repeated batch has the same number."""
    stream = file_metadata(stream_folder(spark, root))
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
