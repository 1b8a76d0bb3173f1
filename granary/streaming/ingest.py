"""Files that arrive in a folder, as a stream: the same stateless expressions as for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.operators import container

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def blobs(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(path)


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of arriving containers."""
    return container.inspect(blobs(spark, path)).drop("content")


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """Arriving files of any known format, decoded; damaged ones carry an error."""
    from pyspark.sql import functions as F

    return container.unpack(blobs(spark, path), F.col("path")).drop("content")


def drain(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Writes everything that has arrived as Parquet, once, and returns; run again, it takes what came since."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
