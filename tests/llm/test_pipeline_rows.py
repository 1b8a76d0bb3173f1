"""Null ids, repeated rows and ids of several texts through the stages of the pipeline."""

import corpus_pipeline
from granary.llm import exact_dedup, mixing, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    return " ".join(f"w{(seed * 7919 + k * k * 31) % 9973}" for k in range(n))


def docs(spark):
    a, b, c, d, e, f = (prose(k) for k in range(1, 7))
    texts = [
        (1, a), (1, a), (None, a),  # a repeated row, and a copy without an id
        (None, b), (None, c),  # unique documents without ids
        (2, d), (2, e), (9, e),  # an id of two texts, one of which is a copy
        (3, f), (3, f + " tail"), (None, f + " end"),  # near copies, two of one id
        (None, None), (None, None),
    ]
    return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in texts], SCHEMA)


def pairs(df):
    return sorted(((r.doc_id or 0, r.text or "") for r in df.collect()))


def test_exact_keeps_one_row_of_each_text(spark):
    given = docs(spark)
    kept = pairs(corpus_pipeline.exact(spark, given, ""))
    want = {}
    for i, t in pairs(given):
        want[t] = max(i, want.get(t, 0))
    assert kept == sorted((i, t) for t, i in want.items())
    judged = pairs(exact_dedup.keep_one(given))  # with repeats, as deduplicate judges rows
    assert judged == sorted([*kept, (1, prose(1)), (0, "")])


def test_near_keeps_one_row_of_each_component(spark):
    kept = pairs(corpus_pipeline.near(spark, corpus_pipeline.exact(spark, docs(spark), ""), ""))
    assert [(i, t) for i, t in kept if t.startswith(prose(6)[:50])] in ([(3, prose(6))], [(3, prose(6) + " tail")])
    assert [(i, t) for i, t in kept if not t.startswith(prose(6)[:50])] == sorted([(1, prose(1)), (0, prose(2)), (0, prose(3)), (2, prose(4)), (9, prose(5)), (0, "")])
    apart = spark.createDataFrame([(5, prose(10)), (5, prose(11)), (5, prose(11) + " z"), (None, prose(12))], "doc_id long, text string")
    assert [i for i, _ in pairs(ngram_join.keep_one(apart))] == [0, 5, 5]


def test_the_mix_takes_each_row_by_itself(spark):
    given = docs(spark)
    plan = mixing.mix(given).collect()
    size, budget = plan[0].source_size, int(plan[0].target)
    rows = mixing.take(given).collect()
    assert sum(len(r.text.split()) for r in rows) == budget == sum(r.taken for r in plan) and budget <= 2 * size
    held = {}
    for _, t in pairs(given):
        held[t] = held.get(t, 0) + 1
    assert all(sum(r.text == t for r in rows) <= 2 * n for t, n in held.items())
