import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import quality_model as Q
from granary.llm import quality_rules as R
from granary.llm import toxicity as X


def labelled(spark, folder):
    return (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))


def agreement(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    return np.mean([a == b for a, b in rows])


def test_quality_on_held_out_rows(spark, small):
    docs, labels = labelled(spark, small)
    scored = Q.classify(docs, labels)
    assert scored.count() == docs.count() and agreement(scored, labels, "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    scored = X.score_toxicity(docs, labels)
    assert agreement(scored, labels, "toxic") > 0.95


def test_held_out_labels_are_not_read(spark, tiny):
    docs, labels = labelled(spark, tiny)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = ({r.doc_id: r.score for r in Q.classify(docs, x).collect()} for x in (labels, flipped))
    assert one == pytest.approx(other)


@pytest.mark.parametrize("score", [Q.classify, X.score_toxicity])
def test_edges(spark, score):
    schema = "doc_id long, text string, score string"
    labels = spark.createDataFrame([(1, None, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x " * 30_000, "c"), (2, "", "b")], schema)
    rows = score(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert score(spark.createDataFrame([], schema), labels.limit(0)).collect() == []


def walk(t, x):
    raw = t.base
    for root in t.roots:
        at = root
        while t.left[at] != at:
            at = t.left[at] if x[t.feature[at]] <= t.threshold[at] else t.right[at]
        raw += t.value[at]
    return 1 / (1 + np.exp(-raw))


def test_flat_trees_walk_like_single_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = Q.fit(x, y, n_trees=30, depth=3)
    assert trees.score(x) == pytest.approx([walk(trees, r) for r in x])
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_a_pair_weighs_more_than_its_parts():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        docs.append(np.unique(np.concatenate([[7] if insult else [], [9] if group else [], rng.integers(100, 5000, 20)]).astype(np.int32)))
        y.append(float(insult and group))
    m = X.fit(docs, np.array(y))
    both, one, other, none = m.score([np.array(d, np.int32) for d in ([7, 9], [7], [9], [])])
    assert both > 0.8 and max(one, other, none) < 0.3


def test_a_term_without_an_effect_of_its_own_enters_by_its_pair():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for _ in range(8000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        likely = 0.7 if insult and group else 0.0 if group else 0.28
        docs.append(np.unique(np.concatenate([[7] if insult else [], [9] if group else [], rng.integers(100, 5000, 20)]).astype(np.int32)))
        y.append(float(rng.random() < likely))
    y, holds = np.array(y), np.array([9 in d for d in docs])
    assert y[holds].mean() == pytest.approx(y[~holds].mean(), abs=0.01)
    m = X.fit(docs, y)
    both, one, other, none = m.score([np.array(d, np.int32) for d in ([7, 9], [7], [9], [])])
    assert 9 in m.bins and both == pytest.approx(0.7, abs=0.05) and one == pytest.approx(0.28, abs=0.05) and other < 0.05


def test_toxicity_query_against_sums_over_all_pairs(spark, tiny):
    docs, labels = labelled(spark, tiny)
    m = X.train(docs, labels, X.held_out(F.col("doc_id"), 4, 2))
    weight, factor = dict(zip(m.bins.tolist(), m.weight)), dict(zip(m.bins.tolist(), m.factor))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in X.score_toxicity(docs, labels).collect():
        terms = {zlib.crc32(t.encode()) % X.BINS for t in re.findall(r"\w+", texts[r.doc_id].lower())} & weight.keys()
        raw = m.bias + sum(weight[t] for t in terms) + sum(factor[s] @ factor[t] for s in terms for t in terms if s < t)
        assert r.score == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9) and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = X.Machine(np.array([2, 5, 8], np.int32), 0.1, rng.normal(size=3), rng.normal(size=(3, 4)))
    doc = np.array([2, 3, 5, 8], np.int32)
    raw = 0.1 + m.weight.sum() + sum(m.factor[i] @ m.factor[j] for i in range(3) for j in range(i))
    assert m.score([doc, np.empty(0, np.int32)]) == pytest.approx([1 / (1 + np.exp(-raw)), 1 / (1 + np.exp(-0.1))])


def brute_stats(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_rule_statistics_against_brute_force(spark, tiny):
    texts = ["", " ", None, "a a a a", "a b c a b c x", "l\nl\n\n\n l\nl", " x y #|<>", "x y z " * 40]
    texts += [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, votes string")
    for r in R.score_quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept <= (not r.base_failed)


def test_more_statistics_against_brute_force():
    for text in ["", "ab #c ... !? é9 a#b", "- | x1", "Äß\n\n| |", "a" * 50_000 + " #"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = dict(zip(R.STATS, R.text_stats(text)))
        assert n["n_symbol_words"] == sum(any(c in "#*$%&|<>" for c in w) for w in words)
        assert n["n_bare_words"] == sum(all(ord(c) < 128 and not c.isalnum() for c in w) for w in words)
        assert n["n_letters"] == sum(c.isalpha() for c in text) and n["n_distinct"] == len(set(words))


def planted(rates, n=60_000, seed=3):
    """Votes of n documents, 85% of them good: how often each rule is wrong on good ones, right on bad ones, and votes at all."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.85
    votes = np.stack([np.where(rng.random(n) < covers, np.where(np.where(good, rng.random(n) < wrong, rng.random(n) < catches), R.BAD, R.GOOD), R.ABSTAIN) for wrong, catches, covers in rates], 1)
    return good, votes


RATES = [(0.08, 0.5, 1.0), (0.01, 0.8, 0.9), (0.02, 0.6, 1.0), (0.01, 0.7, 0.7), (0.03, 0.6, 0.9), (0.01, 0.7, 1.0)]


def test_em_recovers_planted_accuracies():
    good, votes = planted(RATES)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, p = R.fit_votes(patterns, counts.astype(float))
    assert prior == pytest.approx(0.85, abs=0.02)
    assert 1 - p[:, R.GOOD] == pytest.approx([w for w, _, _ in RATES], abs=0.015) and 1 - p[:, R.BAD] == pytest.approx([c for _, c, _ in RATES], abs=0.05)
    kept = R.posterior(patterns, prior, p)[place.ravel()] >= 0.5
    assert (kept == good).mean() > 0.98
    weak_only = (votes[:, 0] == R.BAD) & (votes[:, 1:] != R.BAD).all(1)
    assert kept[weak_only & (votes[:, 1:] != R.ABSTAIN).all(1)].all()  # a weak rule rejects nothing by itself


def plain_em(votes, rounds=500):
    """Document by document."""
    good = [(sum(v == R.GOOD for v in d) + 0.5) / (sum(v != R.ABSTAIN for v in d) + 1) for d in votes]
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(votes) + 2)
        rates = []
        for k in range(len(votes[0])):
            pair = []
            for q, mean in ((good, 0.9), ([1 - x for x in good], 0.5)):
                pair.append((sum(x for x, d in zip(q, votes) if d[k] == R.GOOD) + 20 * mean) / (sum(x for x, d in zip(q, votes) if d[k] != R.ABSTAIN) + 20))
            rates.append((pair[0], min(pair)))
        was, good = good, []
        for d in votes:
            a, b = share, 1 - share
            for v, (g, h) in zip(d, rates):
                if v != R.ABSTAIN:
                    a, b = a * (g if v == R.GOOD else 1 - g), b * (h if v == R.GOOD else 1 - h)
            good.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(good, was)) < 1e-9:
            break
    return good


def plain_votes(n):
    """The votes of the rules on the statistics n of a text."""
    if not n["n_words"]:
        return [R.BAD] * 9
    w = n["n_words"]
    shares = [n["n_symbols"] / w, n["n_symbol_words"] / w, n["n_bare_words"] / w, n["n_letters"] / n["word_chars"], n["n_repeat_words"] / w, n["n_dup_lines"] / n["n_lines"], n["word_chars"] / w, w, n["n_distinct"] / w**0.5]
    bad = [shares[0] > 0.3, shares[1] > 0.25, shares[2] > 0.15, shares[3] < 0.8, shares[4] > 0.4, shares[5] > 0.3 and n["n_lines"] > 3, shares[6] < 2.5 or shares[6] > 12, w < 20, shares[8] < 2]
    ok = [shares[0] < 0.05, shares[1] < 0.05, shares[2] < 0.02, shares[3] > 0.9, shares[4] < 0.1, shares[5] < 0.1, 3 <= shares[6] <= 9, w >= 80, shares[8] > 4]
    return [R.BAD if b else R.GOOD if g else R.ABSTAIN for b, g in zip(bad, ok)]


def test_quality_rules_query_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stats = {i: dict(zip(R.STATS, R.text_stats(t or ""))) for i, t in texts.items()}
    want = dict(zip(texts, plain_em([plain_votes(stats[i]) for i in texts])))
    for r in R.score_quality(docs).collect():
        assert r.posterior == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.kept == (not r.base_failed and want[r.doc_id] >= 0.5)


def test_rules_keep_clean_and_weakly_doubted_and_reject_junk(spark, small):
    docs, labels = labelled(spark, small)
    rows = R.score_quality(docs).join(labels, "doc_id", "left").filter("not base_failed").collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    n_bad = {r.doc_id: plain_votes(dict(zip(R.STATS, R.text_stats(texts[r.doc_id])))).count(R.BAD) for r in rows}
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99 and not any(r.kept for r in rows if r.quality == 0)
    assert not any(r.kept for r in rows if n_bad[r.doc_id] >= 3)


def test_a_weak_doubt_rejects_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {1: [], 3: []}
    for r in R.score_quality(docs).filter("not base_failed").collect():
        bad = plain_votes(dict(zip(R.STATS, R.text_stats(texts[r.doc_id])))).count(R.BAD)
        if bad in kept:
            kept[bad].append(r.kept)
    assert any(kept[1]) and kept[3] and not any(kept[3])  # all-must-pass would reject both


def test_rules_on_an_empty_table(spark):
    assert R.score_quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []
