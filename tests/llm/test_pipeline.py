"""Each stage of the pipeline against a plain version of it, on what its predecessor kept."""

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from granary.llm import mixing, quality_model
from granary.llm.queries import RANKS
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_ngram_join import brute as brute_near


@pytest.fixture(scope="module")
def stages(spark, tiny):
    docs, found = spark.read.parquet(f"{tiny}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, tiny))
        found.append((name, given, docs.collect()))
    return found


def texts(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_stages_are_those_asked_for(stages):
    assert [s[0] for s in stages] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing to target weights", "byte-level BPE"]
    for _, given, kept in stages[:-1]:
        assert kept[0].__fields__ == given[0].__fields__
    for (_, _, kept), (_, given, _) in zip(stages, stages[1:]):
        assert sorted(map(repr, kept)) == sorted(map(repr, given))


def test_quality(spark, tiny, stages):
    _, given, kept = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    fitted = [r for r in given if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = np.stack([quality_model.document_stats(r.text or "") for r in fitted])
    trees = quality_model.fit(x, np.array([float(labels[r.doc_id]) for r in fitted]))
    sure = [(r, s) for r, s in zip(given, trees.score(np.stack([quality_model.document_stats(r.text or "") for r in given]))) if abs(s - 0.5) > 0.1]
    stay = {r.doc_id for r in kept}
    assert [r.doc_id in stay for r, _ in sure] == [s > 0.5 for _, s in sure] and len(sure) > 0.9 * len(given)
    assert {d for d, q in labels.items() if q == 1} <= stay


def test_exact(stages):
    _, given, kept = stages[1]
    stay = {row[0] for row in brute_exact([(r.doc_id, r.text) for r in given]) if row[3]}
    assert texts(kept) == texts([r for r in given if r.doc_id in stay])


def test_near(stages):
    _, given, kept = stages[2]
    stay = {i for i, (_, component) in brute_near([(r.doc_id, r.text) for r in given]).items() if i == component}
    assert texts(kept) == texts([r for r in given if r.doc_id in stay])


def test_mixing(spark, stages):
    _, given, kept = stages[3]
    plan = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(given)).collect()}
    got = {}
    for r in kept:
        got.setdefault(r.doc_id, []).append(r)
    whole = {r.doc_id: r for r in given}
    for i, p in plan.items():
        rows = sorted(got.get(i, []), key=lambda r: -len(r.text.split()))
        assert sum(len(r.text.split()) for r in rows) == p.taken
        for r in rows[: p.taken // p.size if p.size else 0]:
            assert r == whole[i]
        assert all(whole[i].text.startswith(r.text) and r.n_chars == len(r.text) for r in rows)


def test_tokens(stages):
    _, given, kept = stages[4]
    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in kept) == sorted((r.doc_id, library.encode_ordinary(r.text)) for r in given)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in kept)


def test_run_is_the_stages_in_order(spark, tiny, stages):
    got = corpus_pipeline.run(spark, tiny).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.n_tokens) for r in stages[-1][2])
