"""Plans as tables and runs of plans: a row is a job, and a job that can't run says so in its row instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import formats, report
from granary.functions import header as H
from granary.functions.dims import CODECS, MB
from granary.operators import archive, benchmark, container


def plan_compression(blobs: DataFrame, algo: Column | None = None, strategy: Column | None = None, level: Column | None = None, speeds: DataFrame | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """blobs with dest, backend_name, level, input_size, estimated_seconds, can_compress and reason."""
    chosen = formats.codec_for(F.lit("balanced") if strategy is None else F.coalesce(strategy, F.lit("balanced")))
    backend = chosen if algo is None else F.coalesce(F.lower(algo), chosen)
    rows = blobs.withColumns({"dest": report.compressed_path(F.col(path)), "backend_name": backend, "level": F.lit(-1) if level is None else F.coalesce(level, F.lit(-1)), "input_size": F.coalesce(F.octet_length(content), F.lit(0)).cast("long")})
    rows = benchmark.with_speed(rows, F.col("backend_name"), speeds)
    reason = F.when(F.col(content).isNull(), "Source does not exist").when(~F.col("backend_name").isin(*CODECS), F.concat(F.lit("No backend for "), F.col("backend_name")))
    return rows.withColumns({"reason": reason, "can_compress": reason.isNull(), "estimated_seconds": F.when(F.col(content).isNotNull(), F.col("input_size") / MB / F.col("mb_s"))}).drop("mb_s")


def run_compression(plan: DataFrame, content: str = "content", empty: bool = False) -> DataFrame:
    """A plan with packed, ok and error. A blob of no bytes is an error unless `empty`."""
    rows = container.pack(plan.withColumn("__content", F.when(F.col("can_compress"), F.col(content))), F.col("backend_name"), F.col("level"), "__content", empty=empty)
    return rows.withColumn("error", F.coalesce("reason", "error")).withColumn("ok", F.col("error").isNull()).drop("__content")


def plan_decompression(blobs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """blobs with dest, format, inspection (a struct) and estimated_seconds."""
    rows = blobs.withColumns({"dest": report.decompressed_path(F.col(path)), "format": formats.of_blob(F.col(content), F.col(path)), "inspection": H.inspect(F.col(content))})
    return rows.withColumn("estimated_seconds", F.col("inspection.estimated_decomp_s"))


def run_decompression(plan: DataFrame, path: str = "path", content: str = "content", empty: bool = False) -> DataFrame:
    """A plan with data, ok and error. Standalone formats are decoded as well as containers, those of empty blobs if `empty`."""
    return container.unpack(plan, F.col(path), content, empty=empty).withColumn("ok", F.col("error").isNull())


def plan_archive(entries: DataFrame, key: str, name: str = "tar.zst") -> DataFrame:
    """One row per key: entry_count, total_input_size, can_run, reason."""
    plan = entries.groupBy(key).agg(F.count("*").alias("entry_count"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("total_input_size"))
    pipeline = formats.pipeline_of_name(F.lit(name))
    reason = F.when(~formats.supports_archive(F.lit(name)) | (pipeline["archive"] == "none") | ~formats.is_valid(pipeline), F.lit(f"Format does not support archives: {name}"))
    return plan.withColumns({"reason": reason, "can_run": reason.isNull()})


def plan_extraction(archives: DataFrame, key: str, content: str = "archive") -> DataFrame:
    """One row per key: n_entries, total_size, can_run and reason; contents stay packed."""
    listed = archive.entries(archives, [key], content, payload=False)
    return listed.groupBy(key).agg(F.count("path").alias("n_entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.max("error").alias("reason")).withColumn("can_run", F.col("reason").isNull())
