"""What a worker holds and what meets in a task doesn't grow with the table."""

import pytest
from pyspark.sql import functions as F

from granary.functions.batches import bounded_batches
from granary.operators import archive
from granary.plans.queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_volume_is_small(spark):
    rows = spark.range(40).select(F.lit("k").alias("k"), F.concat(F.lit("d/"), "id").alias("path"), F.repeat(F.lit("x"), F.lit(1 << 20)).cast("binary").alias("content"))
    built = archive.build(rows, "k", "tar").select(F.octet_length("archive").alias("n"), F.col("error")).collect()
    assert max(r.n for r in built) < 24 << 20 and sum(r.n for r in built) > 40 << 20 and {r.error for r in built} == {None}


@pytest.mark.parametrize("name", ["archive_list_tar_xz", "archive_plan_extraction"])
def test_an_archive_passes_through_two_workers_only(spark, tiny, name):
    plan = plan_of(QUERIES[name](spark, tiny))
    assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 1


def test_a_volume_is_told_its_own_names_only(spark, tiny, monkeypatch):
    asked, plain = [], archive.extract
    monkeypatch.setattr(archive, "extract", lambda a, keep, *args, **more: asked.append(keep) or plain(a, keep, *args, **more))
    QUERIES["archive_extract_selected"](spark, tiny)
    assert asked == [["source", "volume"]]


def test_small_archives_share_frames(spark, monkeypatch):
    frames, blobs = [], spark.range(500).select("id", F.lit(bytearray(b"no archive")).alias("archive"))
    monkeypatch.setattr(type(blobs), "mapInPandas", lambda self, f, schema: frames.extend(f(iter([self.toPandas()]))) or self)
    archive.entries(blobs, ["id"])
    assert len(frames) == 1 and list(frames[0]["id"]) == list(range(500)) and frames[0]["error"].eq("ValueError: not a readable archive: none").all()


def test_a_listing_tells_the_volumes_of_a_conversion(spark, monkeypatch):
    rows = spark.createDataFrame([("k", "a/", None), ("k", "a/b", bytearray(b"x" * 5000)), ("k", "c", bytearray(b""))], "k string, path string, content binary")
    built, seen, plain = archive.build(rows, "k", "zip", volumes=1), [], archive.volumes_of
    monkeypatch.setattr(archive, "volumes_of", lambda e, *a: seen.append((e.columns, plain(e, "key", 1024).collect())) or plain(e, "key", 1024))
    got = archive.entries(archive.convert(built, "k", "tar.xz"), ["k"])
    assert sorted((r.path.rstrip("/"), r.size) for r in got.collect()) == [("a", 0), ("a/b", 5000), ("c", 0)]
    assert [c for c, _ in seen] == [["key", "path", "size"]] and seen[0][1] == [("k", 8)]


def test_speeds_are_broadcast(spark, tiny):
    assert "hashpartitioning" not in plan_of(QUERIES["plan_estimates"](spark, tiny))


@pytest.mark.parametrize("name", ["standalone_roundtrip_bzip2", "container_roundtrip"])
def test_batches_of_packed_blobs_have_few_rows(spark, tiny, name):
    QUERIES[name](spark, tiny)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
    bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000
