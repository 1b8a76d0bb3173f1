import random

import pytest

from granary.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, n_chars long"


def rows_of(seed, sources):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40])), rnd.choice(sources), 0) for i in range(400)]


def fill(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or open_:
            target[s] = min(2 * sizes[s], weight[s] * level) if over else weight[s] * level
        total -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


@pytest.mark.parametrize("sources", [["a", "b", None], ["hot"] * 30 + ["x", "Z", "é", "", None], ["one"], ["s%d" % k for k in range(20)]])
def test_targets_and_budgets(spark, sources):
    rows = rows_of(3, sources)
    got = M.mix(spark.createDataFrame(rows, SCHEMA), range_rows=37).collect()
    source = {r[0]: r[2] for r in rows}
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = fill(sizes), {}
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert len(got) == len(rows) and all(taken[s] == int(want[s] + 1e-6) or abs(taken[s] - want[s]) < 1 for s in want)


def test_ranges_and_reruns_change_nothing(spark):
    df = spark.createDataFrame(rows_of(4, ["a", "b", "b", "b"]), SCHEMA)
    one, other = (sorted(map(tuple, M.mix(d, range_rows=n).collect())) for d, n in ((df, 10_000), (df.repartition(7), 13)))
    assert one == other


def test_take(spark):
    df = spark.createDataFrame([(1, "a b  c d\n", "x", 9), (2, "e f g", "x", 5), (3, "", "y", 0), (4, None, None, None)], SCHEMA)
    plan = {r.doc_id: r.taken for r in M.mix(df).collect()}
    words = {}
    for r in M.take(df).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in plan.items() if v}


def test_edges(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, None, None, 1, 1), (1, "a", None, 1, 1), (1, "a", None, 1, 1)], SCHEMA + ", size int")
    assert sorted((r.doc_id or 0, r.size, r.source_size) for r in M.mix(df).collect()) == [(0, 0, 2), (1, 1, 2), (1, 1, 2)]
    empty = M.mix(spark.createDataFrame([(1, "", "a", 1)], SCHEMA)).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)]
