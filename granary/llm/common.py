"""Expressions and helpers that several corpus operators share."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a row's number that count inside its file.
FILE_ROW_BITS = 36


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in; lower() would also change other letters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that it is computed once and outlives its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rows(df: DataFrame, name: str, placed: bool = False) -> DataFrame:
    """df with a number of each row in column `name`; every later use of a row sees the same number.

    If `placed`, df gives each row of some Parquet files once at most, and a row's number is its place in them, so that nothing is copied: the files are
    numbered by name, in a table with a row for each. Any other df is written once. A df without places counts as not placed.
    """
    try:
        found = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")) if placed else None
    except AnalysisException:
        found = None
    if found is None:
        return materialise(df.withColumn(name, F.monotonically_increasing_id()))
    files = found.select("__file").distinct().withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("long"))
    numbered = found.join(materialise(files), "__file").withColumn(name, F.shiftleft("__number", FILE_ROW_BITS) + F.col("__at"))
    return numbered.select(*df.columns, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
