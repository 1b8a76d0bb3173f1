import pytest
from pyspark.sql import functions as F

from granary.operators import archive
from granary.plans.queries import QUERIES


def test_volumes_grow_with_the_bytes_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(archive, "VOLUME_BYTES", 64 << 10)
    rows = [(k, f"d/{i}", bytearray(b"x" * 2000)) for k, n in (("hot", 600), (None, 100), ("small", 3)) for i in range(n)]
    built = archive.build(spark.createDataFrame(rows, "k string, path string, content binary"), "k", "tar").cache()
    made = {r.k: (r.n, r.most) for r in built.groupBy("k").agg(F.count("*").alias("n"), F.max(F.octet_length("archive")).alias("most")).collect()}
    assert {k: n for k, (n, _) in made.items()} == {"hot": 28, None: 5, "small": 1}
    assert max(most for _, most in made.values()) < 3 * (64 << 10)
    got = sorted((r.k or "", r.path, r.size) for r in archive.entries(built, ["k"]).collect())
    assert got == sorted((k or "", p, len(c)) for k, p, c in rows)


@pytest.mark.parametrize("name", ["archive_list_tar", "archive_extract_selected", "archive_missing", "archive_convert", "archive_plan_extraction", "archive_nested_paths"])
def test_queries_bound_their_groups(spark, tiny, monkeypatch, name):
    want = sorted(map(repr, QUERIES[name](spark, tiny).collect()))
    monkeypatch.setattr(archive, "VOLUME_BYTES", 4 << 10)
    counts, plain = [], archive.build

    def build(entries, key, *args, **more):
        out = plain(entries, key, *args, **more)
        counts.append(out.groupBy(key).count().agg(F.max("count")).first()[0])
        return out
    monkeypatch.setattr(archive, "build", build)
    assert sorted(map(repr, QUERIES[name](spark, tiny).collect())) == want
    assert max(counts) > 4
