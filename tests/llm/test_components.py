"""Components of odd graphs, and the size of what the driver keeps of a round."""

import random

import pytest
from pyspark.sql import functions as F

from granary.llm import blocks, components


def brute(pairs):
    root = {x: x for p in pairs for x in p}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return sorted((x, find(x)) for x in root if find(x) != x)


def random_pairs(seed, n=300):
    rng = random.Random(seed)
    return [(rng.randrange(n) - 50, rng.randrange(n) - 50) for _ in range(n // 2)]


GRAPHS = {
    "none": [],
    "loops": [(1, 1), (2, 2)],
    "stars": [(1, k) for k in range(2, 300)] + [(k, 1000) for k in (1001, 1002)],
    "chain": [(k, k + 1) for k in range(120)],
    "chain, shuffled ids": [((k * 37) % 121, ((k + 1) * 37) % 121) for k in range(120)],
    "hub is the largest": [(k, 10**12) for k in range(-5, 200)],
    "both ways, repeated": [(3, 4), (4, 3), (4, 3), (5, 3), (9, 8)],
    "random": random_pairs(1),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    got = components.components(spark.createDataFrame(GRAPHS[name], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == brute([p for p in GRAPHS[name] if p[0] != p[1]])


def test_least_of_each_key(spark):
    rows = [(k % 7, (k * 31) % 997, str(k)) for k in range(2000)] + [(None, 5, "x")]
    got = blocks.group_min(spark.createDataFrame(rows, "k int, x long, name string"), ["k"], F.col("x"), "low").collect()
    low = {k: min(x for j, x, _ in rows if j == k) for k in range(7)}
    assert sorted(map(tuple, got)) == sorted((k, x, n, low[k]) for k, x, n in rows if k is not None)


def test_finished_stars_take_no_round_and_others_small_plans(spark, monkeypatch):
    written, plain = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")) or plain(df))
    components.components(spark.createDataFrame([(1, k) for k in range(2, 9)], "a long, b long"))
    assert len(written) == 1
    components.components(spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "a long, b long"))
    assert len(written) > 1 and max(written) <= 4
