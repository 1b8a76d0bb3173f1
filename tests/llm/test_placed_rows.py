"""Rows told apart by their place in Parquet files."""

import corpus_pipeline
from granary.llm import common
from tests.llm.test_pipeline_rows import docs, pairs


def test_placed(spark, tmp_path):
    docs(spark).repartition(3).write.parquet(f"{tmp_path}/d")
    given = spark.read.parquet(f"{tmp_path}/d")
    n = common.with_rows(given, "r", placed=True)
    assert n.columns == [*given.columns, "r"] and n.select("r").distinct().count() == 13 == n.count()
    assert "_metadata" not in str(n.columns) and sorted(n.collect(), key=lambda r: r.r) == sorted(n.collect(), key=lambda r: r.r)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert pairs(stage(spark, given, "")) == pairs(stage(spark, docs(spark), ""))
