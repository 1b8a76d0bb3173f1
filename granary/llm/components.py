"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.blocks import group_min
from granary.llm.common import materialise


def _both_ways(edges: DataFrame, v: str, u: str) -> DataFrame:
    """v, u and u, v of each edge, from one scan."""
    ends = F.array(F.struct(F.col(v).alias("v"), F.col(u).alias("u")), F.struct(F.col(u).alias("v"), F.col(v).alias("u")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def only_stars(edges: DataFrame) -> bool:
    """Whether each v of the distinct edges (v > u) hangs on one u, on which nothing else hangs but other v: then u is its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("v").alias("id"), F.lit(1).alias("up")), F.struct(F.col("u").alias("id"), F.lit(0).alias("up")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("all")).filter("ups > 0 AND all > 1").count() == 0


def components(links: DataFrame) -> DataFrame:
    """a, b -> id, component: the least id that each linked id reaches. Ids without links don't occur, nor does the least id itself.

    Every round ties each id to the least of its neighbourhood, until only stars are left, however long the chains of
    links are (the rounds grow with the logarithm of their length). The edges never leave the executors. Each half of a round is
    written, so that its plan stays small: the driver holds the plans and tasks of all rounds.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while not only_stars(edges):
        # large star: every larger neighbour of v moves to the least of v's neighbourhood
        large = group_min(_both_ways(edges, "v", "u"), ["v"], F.col("u"), "near").filter("u > v")
        large = materialise(large.select(F.col("u").alias("v"), F.least("near", "v").alias("u")))
        # small star: v and its smaller neighbours move to the least of them
        least = group_min(large, ["v"], F.col("u"), "m").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u"))
        edges = materialise(least.filter("v <> u").distinct())
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
