import hashlib
import random

import numpy as np
import pytest

from granary.llm import run_index
from granary.llm import suffix_dedup as S
from granary.llm.run_index import RunIndex


def brute(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - 49):
            s = t[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


def result(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate(df, **how).collect()}


def found(strings, values, pattern, span):
    """Matching statistics up to span, and the least value of the strings that hold span bytes."""
    out = []
    for i in range(len(pattern)):
        n = 0
        while n < min(span, len(pattern) - i) and any(pattern[i : i + n + 1] in s for s in strings):
            n += 1
        out.append((n, min([v for s, v in zip(strings, values) if n == span and pattern[i : i + n] in s], default=np.iinfo(np.int64).max)))
    return out


def flat(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])


@pytest.mark.parametrize("triple", [1 << 21, 0])
def test_matching_statistics_against_search(monkeypatch, triple):
    monkeypatch.setattr(run_index, "TRIPLE", triple)
    rnd = random.Random(4)
    for trial in range(80):
        alphabet = [b"ab", b"abcde", b"a", bytes([0, 255])][trial % 4]
        some = lambda most: [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120 if trial % 3 else 30))) for _ in range(rnd.randint(1, most))]
        strings, patterns = some(10), some(8)
        strings += [p[: rnd.randint(1, len(p))] for p in patterns[:3]]
        values = np.array([rnd.randrange(100) for _ in strings])
        span = rnd.choice([4, 5, 13, 50])
        lengths, least = RunIndex(*flat(strings), values, span).stream(*flat(patterns))
        assert list(zip(lengths.tolist(), least.tolist())) == [x for p in patterns for x in found(strings, values, p, span)]


def test_runs_are_few_where_text_repeats():
    one = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(300))
    index = RunIndex(*flat([one] * 50), np.arange(50), 50)
    assert index.n_runs < 700  # of 15,050 symbols


def test_against_brute_force(spark):
    rnd = random.Random(8)
    line = lambda n, a="abcdefgh éü": "".join(rnd.choice(a) for _ in range(n))
    passages = [line(n) for n in (49, 50, 51, 60, 120, 400, 1500)]
    rows = []
    for _ in range(120):
        parts = [rnd.choice([line(rnd.randint(0, 90)), rnd.choice(passages), rnd.choice(passages)[rnd.randint(0, 20) :], "ab" * rnd.randint(0, 150), "-" * rnd.randint(0, 200)]) for _ in range(rnd.randint(0, 5))]
        rows.append("".join(parts))
    rows += [rows[3], rows[3], rows[7] + "tail", None, "", "x" * 49, "x" * 49, "y" * 50, "y" * 50, "y" * 51]
    rows = list(enumerate(rows))
    rnd.shuffle(rows)
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, hot_docs=5) == brute(rows)  # the commonest minimizers are dealt string by string


def test_given_documents(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_pieces_of_a_long_text_join(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [b"".join(bytes([rnd.randrange(97, 105)]) for _ in range(3000)) for _ in range(2)]
    monkeypatch.setattr(S, "PIECE_BYTES", 300)
    seen = set()
    for phrases, doc, place in S._parsed(texts, np.empty(0, np.uint64)):
        for d, p, n in zip(doc.tolist(), place.tolist(), phrases.strings.tolist()):
            assert not seen & {(d, p + k) for k in range(n)}
            seen |= {(d, p + k) for k in range(n)}
    assert len(seen) == 2 * (3000 - 49)


def test_edges(spark):
    assert result(spark, []) == {}
    long = "the same long passage that several documents share, word for word, "
    df = spark.createDataFrame([(5, long, "a"), (5, long, "b"), (None, long, "c"), (2, long + "x", "d")], "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in S.deduplicate(df).collect())
    assert got == [(0, 0, 0), (2, 0, 0), (5, len(long), 1), (5, len(long), 1)]
    kept = {r.doc_id: bytes(r.kept) for r in S.deduplicate(df.filter("doc_id is not null"), with_text=True).collect()}
    assert kept == {2: (long + "x").encode(), 5: b""}
