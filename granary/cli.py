"""Command line over the library: python -m granary.cli pack|unpack|archive|extract|inspect|bench|codecs PATH ... [options]

Paths are files or folders that Spark can read; results are written below --out, one file per row, or shown.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import dims, report
from granary.operators import archive, benchmark, container
from granary.plans import jobs
from granary.sources import files


def _relative(rows: DataFrame, root: str) -> DataFrame:
    """path below root; of a single file its name."""
    root = root.rstrip("/")
    inner = F.when(F.instr("path", root + "/") > 0, F.substring_index("path", root + "/", -1)).otherwise(F.substring_index("path", "/", -1))
    return rows.withColumn("path", inner)


def _save(rows: DataFrame, out: str, overwrite: bool) -> None:
    rows.filter("content IS NOT NULL").select("path", "content").write.format("files").mode("append").option("overwrite", str(overwrite).lower()).save(out)


def _show(rows: DataFrame, as_json: bool = False) -> None:
    if as_json:
        rows = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    rows.show(1000, truncate=False)


def pack(spark: SparkSession, a) -> None:
    blobs = _relative(files.blobs(spark, a.path), a.path)
    plan = jobs.plan_compression(blobs, F.lit(a.algo) if a.algo else None, F.lit(a.strategy), F.lit(a.level))
    done = jobs.run_compression(plan).persist()
    _save(done.select(F.col("dest").alias("path"), F.col("packed").alias("content")), a.out, a.overwrite)
    size = F.octet_length("packed")
    _show(done.select("path", "backend_name", report.format_size(F.col("input_size")).alias("size"), report.format_size(size).alias("packed"), F.format_string("%.1f%%", report.saved_percent(size, F.col("input_size"))).alias("saved"), "error"))


def unpack(spark: SparkSession, a) -> None:
    done = jobs.run_decompression(jobs.plan_decompression(_relative(files.blobs(spark, a.path), a.path))).persist()
    _save(done.select(F.col("dest").alias("path"), F.col("data").alias("content")), a.out, a.overwrite)
    _show(done.select("path", "format", "dest", report.format_size(F.octet_length("data")).alias("size"), "error"))


def bundle(spark: SparkSession, a) -> None:
    rows = _relative(files.blobs(spark, a.path), a.path).withColumn("key", F.lit(a.path.rstrip("/").rpartition("/")[2]))
    built = archive.build(rows.select("key", "path", "content"), "key", a.format, a.level, a.volumes)
    name = F.when(F.lit(a.volumes > 1), F.format_string(f"%s-%05d.{a.format}", "key", "volume")).otherwise(F.format_string(f"%s.{a.format}", "key"))
    _save(built.select(name.alias("path"), F.col("archive").alias("content")), a.out, a.overwrite)
    _show(jobs.plan_archive(rows, "key", a.format))


def extract(spark: SparkSession, a) -> None:
    archives = files.blobs(spark, a.path).select(F.col("path").alias("from"), "content")
    if a.list:
        _show(archive.entries(archives, ["from"], "content", F.col("from"), payload=False).drop("content"))
        return
    wanted = spark.createDataFrame([(n,) for n in a.names], "path string") if a.names else None
    rows = archive.extract(archives, ["from"], wanted, "content", F.col("from")).persist()
    _save(rows.filter("error IS NULL AND type = 'file'"), a.out, a.overwrite)
    _show(rows.select("from", "path", "type", "size", "error"))


def inspect(spark: SparkSession, a) -> None:
    heads = spark.read.format("prefix").option("bytes", 16).load(a.path)
    _show(container.inspect(heads).drop("content"), a.json)


def bench(spark: SparkSession, a) -> None:
    every = {"algos": list(dims.CODECS), "strategies": list(dims.PRIORITY)}
    pick = lambda text, name: spark.range(1).select(report.names(F.lit(text), every[name])).first()[0]
    levels = spark.range(1).select(report.levels(F.lit(a.levels))).first()[0]
    grid = benchmark.grid(spark, pick(a.algos, "algos"), pick(a.strategies, "strategies"), levels)
    results = benchmark.run(files.blobs(spark, a.path), grid, a.repeats).persist()
    _show(benchmark.printed(results))
    if a.speeds:
        known = spark.createDataFrame(files.speeds(spark, a.speeds).collect(), benchmark.SPEEDS)  # six rows: read before it is overwritten
        files.save_speeds(benchmark.merge_speeds(known, benchmark.metrics(results)), a.speeds)


def codecs(spark: SparkSession, a) -> None:
    _show(dims.codecs(spark))
    _show(dims.archive_formats(spark))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="granary", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(function, *names, path=True, out=True):
        p = sub.add_parser(names[0], aliases=names[1:])
        p.set_defaults(run=function)
        if path:
            p.add_argument("path")
        if out:
            p.add_argument("--out", "-o", default="out")
            p.add_argument("--overwrite", action="store_true")
        return p

    p = command(pack, "pack", "compress", "c")
    p.add_argument("--algo", "-a")
    p.add_argument("--strategy", "-s", default="balanced", choices=list(dims.PRIORITY))
    p.add_argument("--level", "-l", type=int, default=-1)
    command(unpack, "unpack", "decompress", "d")
    p = command(bundle, "archive", "a")
    p.add_argument("--format", "-f", default="tar.zst")
    p.add_argument("--level", "-l", type=int, default=-1)
    p.add_argument("--volumes", type=int, default=1)
    p = command(extract, "extract", "x")
    p.add_argument("names", nargs="*")
    p.add_argument("--list", action="store_true")
    p = command(inspect, "inspect", "i", out=False)
    p.add_argument("--json", action="store_true")
    p = command(bench, "bench", "benchmark", "b", out=False)
    p.add_argument("--algos", default="all")
    p.add_argument("--strategies", default="all")
    p.add_argument("--levels", default="auto")
    p.add_argument("--repeats", type=int, default=1)
    p.add_argument("--speeds")
    command(codecs, "codecs", "list", "l", path=False, out=False)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("granary").getOrCreate()
    files.register(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
