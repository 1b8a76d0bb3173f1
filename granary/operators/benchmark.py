"""Benchmark grids, their metrics, and the table of measured speeds that they feed."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions import codecs
from granary.functions.batches import bounded_batches
from granary.functions.dims import CODECS, COMPRESS_MB_S, DECOMPRESS_MB_S, OTHER_MB_S, PRIORITY, lookup
from granary.functions.report import mb_per_s, ratio

LEVELS = (None, 1, 3, 6, 9)
#: Configurations times repeats that run() takes.
MOST_TRIES = 2_000
SPEEDS = "algo string, comp_mb_s double, decomp_mb_s double, samples long"
_TIMED = T.StructType([T.StructField("compress_time", T.DoubleType()), T.StructField("decompress_time", T.DoubleType()), T.StructField("compressed_size", T.LongType()), T.StructField("same", T.BooleanType())])


def grid(spark: SparkSession, algos=tuple(CODECS), strategies=tuple(PRIORITY), levels=LEVELS) -> DataFrame:
    """algo, strategy, level: every combination. The lists are short and given by the caller."""
    rows = [(a, s, n) for a in algos for s in strategies for n in levels]
    return spark.createDataFrame(rows, "algo string, strategy string, level int")


@pandas_udf(_TIMED)
def _timed(content: pd.Series, algo: pd.Series, level: pd.Series) -> pd.DataFrame:
    out = []
    for x, a, n in zip(content, algo, level):
        begun = time.perf_counter()
        packed, error = codecs.attempt(lambda: codecs.ENCODERS[a](x, -1 if pd.isna(n) else int(n)))  # noqa: B023
        middle = time.perf_counter()
        raw, error = (None, error) if error else codecs.attempt(lambda: codecs.DECODERS[a](packed, len(x)))  # noqa: B023
        out.append((middle - begun, time.perf_counter() - middle, len(packed or b""), raw == x))
    return pd.DataFrame(out, columns=_TIMED.names)


def run(blobs: DataFrame, configurations: DataFrame, repeats: int = 1) -> DataFrame:
    """content -> algo, strategy, level, compress_time, decompress_time, input_size, compressed_size, same: sums over the blobs of mean times over repeats.

    A configuration that a codec can't run has same = false. Configurations are broadcast, so that each blob is timed where it lies; more than MOST_TRIES
    of them raise ValueError. varying_sizes counts the blobs whose packed size differed between repeats, whose last size counts.
    """
    if configurations.count() * repeats > MOST_TRIES:
        raise ValueError(f"more than {MOST_TRIES} timings of each blob")
    bounded_batches(blobs.sparkSession)
    some = blobs.select(F.col("content").cast("binary").alias("content")).filter(F.octet_length("content") > 0)
    tries = configurations.withColumn("tries", F.sequence(F.lit(1), F.lit(repeats)))
    timed = F.transform("tries", lambda _: F.struct("content", "algo", "level"))  # repeats of a blob stand side by side
    rows = some.select(F.monotonically_increasing_id().alias("blob"), "content").join(F.broadcast(tries)).select("blob", "algo", "strategy", "level", F.posexplode(timed).alias("try", "c"))
    rows = rows.withColumn("t", _timed("c.content", "c.algo", "c.level")).withColumn("n", F.octet_length("c.content")).drop("c")
    sizes = rows.groupBy("algo", "strategy", "level", "blob").agg(
        F.sum("t.compress_time").alias("compress_time"), F.sum("t.decompress_time").alias("decompress_time"), F.first("n").alias("n"),
        F.max_by("t.compressed_size", "try").alias("size"), F.count_distinct("t.compressed_size").alias("sizes"), F.bool_and("t.same").alias("same"),
    )
    return sizes.groupBy("algo", "strategy", "level").agg(
        (F.sum("compress_time") / repeats).alias("compress_time"),
        (F.sum("decompress_time") / repeats).alias("decompress_time"),
        F.sum("n").alias("input_size"),
        F.sum("size").alias("compressed_size"),
        F.bool_and("same").alias("same"),
        F.count_if(F.col("sizes") > 1).alias("varying_sizes"),
    )


def metrics(results: DataFrame) -> DataFrame:
    """results with ratio, comp_mb_s and decomp_mb_s, each 0 where it would divide by 0."""
    return results.withColumns({"ratio": ratio(F.col("compressed_size"), F.col("input_size")), "comp_mb_s": mb_per_s(F.col("input_size"), F.col("compress_time")), "decomp_mb_s": mb_per_s(F.col("input_size"), F.col("decompress_time"))})


def printed(results: DataFrame) -> DataFrame:
    """A report line for each result, as text columns."""
    shown = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    return metrics(results).select("algo", "strategy", F.coalesce(F.col("level").cast("string"), F.lit("auto")).alias("level"), shown("ratio", 4).alias("ratio"), shown("comp_mb_s", 2).alias("comp_mb_s"), shown("decomp_mb_s", 2).alias("decomp_mb_s"), shown("compress_time", 3).alias("compress_time"), shown("decompress_time", 3).alias("decompress_time"))


def merge_speeds(known: DataFrame, samples: DataFrame) -> DataFrame:
    """Known speeds with new samples (algo, comp_mb_s, decomp_mb_s): a mean weighted by the number of samples.

    Samples without an algo or with a speed of 0 or less are left out. A known row without samples is replaced.
    """
    good = samples.filter("algo IS NOT NULL AND algo <> '' AND comp_mb_s > 0 AND decomp_mb_s > 0")
    new = good.groupBy("algo").agg(F.avg("comp_mb_s").alias("c"), F.avg("decomp_mb_s").alias("d"), F.count("*").alias("n"))
    both = known.join(new, "algo", "full_outer")
    fresh = F.col("samples").isNull() | (F.col("samples") <= 0)

    def merged(old: str, mean: str) -> Column:
        weighted = (F.col(old) * F.col("samples") + F.col(mean) * F.col("n")) / (F.col("samples") + F.col("n"))
        return F.when(F.col("n").isNull(), F.col(old)).when(fresh, F.col(mean)).otherwise(weighted).alias(old)

    count = F.when(F.col("n").isNull(), F.col("samples")).when(fresh, F.col("n")).otherwise(F.col("samples") + F.col("n"))
    return both.select("algo", merged("comp_mb_s", "c"), merged("decomp_mb_s", "d"), count.alias("samples"))


def with_speed(rows: DataFrame, algo: Column, speeds: DataFrame | None = None, decompress: bool = False, out: str = "mb_s") -> DataFrame:
    """rows with the estimated speed of their codec: measured if it is positive, else the default, else 200.

    speeds has a row for each codec, so it is broadcast; rows dealt by codec would meet in a few tasks.
    """
    fixed = F.coalesce(lookup(DECOMPRESS_MB_S if decompress else COMPRESS_MB_S, F.lower(algo)), F.lit(OTHER_MB_S))
    if speeds is None:
        return rows.withColumn(out, fixed)
    measured = speeds.select(F.col("algo").alias("__algo"), F.col("decomp_mb_s" if decompress else "comp_mb_s").alias("__speed"))
    joined = rows.join(F.broadcast(measured), F.lower(algo) == F.col("__algo"), "left")
    return joined.withColumn(out, F.coalesce(F.when(F.col("__speed") > 0, F.col("__speed")), fixed)).drop("__algo", "__speed")
