import random
import re
from collections import defaultdict

import numpy as np
import pytest

from granary.llm import ngram_join as N
from granary.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        met = defaultdict(int)
        for x in s:
            for o in at[x]:
                if o < k:
                    met[o] += 1
        for o, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                up[find(k)] = find(o)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, **more).collect()}


def test_shingles_are_those_of_the_words():
    rnd = random.Random(3)
    texts = ["", " \t\n", "a", "A a", "a b c d", "a b c d e", "ÄÖ ü x y z É w", "x" * 3000] + [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    sets = N.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    names = {}
    for t, s in zip(texts, sets):
        for x, h in zip(sorted(brute_set(t)), [None] * len(s)):
            names.setdefault(x, h)
    assert len(np.unique(np.concatenate(sets))) == len(set().union(*map(brute_set, texts)))
    assert N.shingle_sets(["A B c D e f"])[0].tolist() == N.shingle_sets(["a b C d E\n f"])[0].tolist()


def test_prefix_grows_only_while_it_pays():
    held, matches = N.choose_prefix(np.array([2] * 20), 20)
    assert held == 20 - 15 + matches and matches >= 1
    assert N.choose_prefix(np.array([5, 5]), 100) == (0, 1)  # unshared shingles fill the prefix
    cheap, dear = N.choose_prefix(np.array([2] * 40), 40)[1], N.choose_prefix(np.array([2] * 11 + [100000] * 29), 40)[1]
    assert cheap > dear == 1


def test_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 2, 8, 25])):
            own = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            rows.append(" ".join(own))
    rows += ["", None, "a b", "A B", "one", " \n", "common words that many share here " * 3] + ["common words that many share here and then " + rnd.choice(vocab) + " " + rnd.choice(vocab) for _ in range(40)]
    rnd.shuffle(rows)
    rows = list(enumerate(rows, 5))
    assert result(spark, rows) == brute(rows)


def test_given_documents(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    assert result(spark, []) == {}
    assert result(spark, [(1, None), (2, "")]) == {1: (0, 1), 2: (0, 2)}
    text = "a b c d e f g h"
    df = spark.createDataFrame([(3, text, "x"), (3, text, "y"), (None, text, "z"), (9, "q " * 50_000, "")], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect())
    assert got == [(0, 4, 3), (3, 4, 3), (3, 4, 3), (9, 1, 9)]
    kept = N.keep_one(spark.createDataFrame([(4, text, "x"), (2, text, "y"), (7, "other", "z")], "doc_id long, text string, component_id string"))
    assert sorted(map(tuple, kept.collect())) == [(2, text, "y"), (7, "other", "z")]


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)]
    random.Random(1).shuffle(path)
    got = {r.id: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 160)}}


@pytest.mark.parametrize("edits,linked", [(1, True), (4, False)])
def test_threshold(spark, edits, linked):
    words = [f"t{i}" for i in range(60)]
    other = list(words)
    for k in range(edits):
        other[7 + 14 * k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other))]
    assert result(spark, rows) == brute(rows)
    assert (result(spark, rows)[2][1] == 1) == linked


def test_overlaps_of_blocks(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 40, rng.integers(0, 20))) for _ in range(n)] for n in (5, 7))
    assert N._overlaps(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert N._overlaps([], right).shape == (0, 7) and N._overlaps([np.empty(0, int)], right).tolist() == [[0] * 7]


@pytest.mark.parametrize("block", [3, 512])
def test_large_loose_group(spark, monkeypatch, block):
    """Many copies of one text with so many edits that some link, some don't, and few link to the hub."""
    monkeypatch.setattr(N, "BLOCK_SETS", block)
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(70):
        own = list(words)
        for _ in range(rnd.randint(0, 7)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(30)}"
        rows.append((k, " ".join(own)))
    assert result(spark, rows) == brute(rows)
