import hashlib
import random

from pyspark.sql import functions as F

from granary.llm import exact_dedup as E

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return sorted((i, max(groups[n]), len(groups[n]), i == max(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [(t or "").translate(LOWER)])


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, E.deduplicate(df, **more).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_chunks_join_to_the_text(spark):
    rnd = random.Random(1)
    texts = ["", "a", "x" * 20_000, "é\n" * 5000] + ["".join(rnd.choice("ab .\né") for _ in range(rnd.randint(0, 9000))) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", E.chunks(F.col("text")).alias("c"))
    for text, chunks in df.collect():
        assert "".join(chunks) == text and max(map(len, chunks), default=0) <= E.CHUNK_MAX


def test_against_brute_force(spark):
    rnd = random.Random(2)
    texts = ["", None, "A", "a", "É", "é", " a", "same " * 3000, "SAME " * 3000, "same " * 2999] + ["".join(rnd.choice("aAb. ") for _ in range(rnd.randint(0, 4))) for _ in range(300)]
    rows = list(enumerate(texts, 10))
    assert result(spark, rows) == brute(rows)


def test_shared_identifiers_are_found_and_avoided(spark):
    def weak(chunk, seed):  # all chunks of one length share an identifier until the third seed
        return F.array(F.length(chunk).cast("long")) if seed < 2 else E.chunk_id(chunk, seed)

    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert E.verified_seed(df, weak) == 2
    assert result(spark, rows, make_id=weak) == brute(rows)


def test_edges(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(1, "x", "p"), (1, "X", "q"), (None, "x", "r"), (None, "z", "s")], "doc_id long, text string, recipe string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in E.deduplicate(df).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert sorted(r.recipe for r in E.keep_one(df).collect() if r.doc_id) == ["p", "q"]
