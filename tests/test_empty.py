"""Queries over tables that hold empty texts too give the rows of their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.functions import codecs
from granary.operators import container
from granary.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sparse(spark, tiny, tmp_path_factory) -> str:
    """Some documents, and an empty one for every case that queries tell by the id."""
    folder = tmp_path_factory.mktemp("sparse")
    duckdb.sql(f"COPY (SELECT * FROM '{tiny}/documents.parquet' WHERE doc_id < 40 UNION ALL SELECT 1000 + i, '', 'en', 'none', 0 FROM range(132) AS t(i)) TO '{folder}/documents.parquet'")
    return str(folder)


def rows_of(spark, folder: str, name: str) -> tuple[list, list]:
    got = QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


@pytest.fixture
def short_plans(monkeypatch):
    """Blobs are unpacked from a table of their own; planned with how they were packed and hurt, they take a minute."""
    plain = container.unpack
    monkeypatch.setattr(container, "unpack", lambda blobs, *args, **more: plain(blobs.localCheckpoint(), *args, **more))


@pytest.mark.parametrize("name", ["container_inspect", "plan_decompression"])
def test_headers_of_empty_blobs(spark, sparse, name):
    got, want = rows_of(spark, sparse, name)
    assert got == want


@pytest.mark.parametrize("name", ["container_roundtrip", "damaged_blobs", "decompress_any", "run_compression"])
def test_round_trips_of_empty_blobs(spark, sparse, short_plans, name):
    got, want = rows_of(spark, sparse, name)
    assert got == want


def test_empty_blobs_are_refused_unless_asked_for(spark):
    blobs = spark.createDataFrame([(name, bytearray()) for name in codecs.ENCODERS], "codec string, content binary")
    assert {r.error for r in container.pack(blobs, F.col("codec")).collect()} == {"ValueError: empty input"}
    packed = container.pack(blobs, F.col("codec"), empty=True).select("codec", F.col("packed").alias("content")).localCheckpoint()
    assert {r.error for r in container.unpack(packed).collect()} == {"HeaderError: original size is 0"}
    assert {(bytes(r.data), r.error) for r in container.unpack(packed, empty=True).collect()} == {(b"", None)}
    bare = container.unpack(packed.select("codec", F.substring("content", 1, 16).alias("content")), empty=True).collect()
    assert {r.codec for r in bare if r.error is None} == {"snappy"}  # whose blocks have no end mark
