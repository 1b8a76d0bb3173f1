"""Bounds for the Arrow batches that Python workers hold whole."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, softly: a single larger row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch of blobs; Spark's default is 10,000.
BLOB_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Every builder sets this one value, so none changes the plans of another."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.unset(_ROWS)


def blob_batches(spark: SparkSession) -> None:
    """The same for blobs, which decode to many times the bytes of their batch: fewer rows bound what comes out of it. Only costs depend on it, no results."""
    bounded_batches(spark)
    spark.conf.set(_ROWS, BLOB_ROWS)
