"""Flipped bytes that leave the content as it was, as where text repeats."""

import random

import pytest

from granary.functions import standalone
from granary.plans.queries import QUERIES


def repeating() -> str:
    """Of its gzip file the byte in the middle can be flipped without any change of the content."""
    r = random.Random(3016)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(r.randint(2, 60))]
    return " ".join(r.choices(words, k=r.randint(40, 700)))


def test_every_flipped_byte_of_an_lz4_file_is_an_error():
    text = random.Random(5).randbytes(300)
    data = b"".join([text, b"-" * 900, text, b"+" * 900, text, random.Random(6).randbytes(70_000)])
    packed = standalone.ENCODERS["lz4"](data, -1)
    assert standalone.DECODERS["lz4"](packed) == data
    for at in range(800):
        hurt = bytearray(packed)
        hurt[at] ^= 255
        with pytest.raises(Exception):
            standalone.DECODERS["lz4"](bytes(hurt))


def test_harmless_flips_are_told_by_a_checksum(spark, tmp_path):
    text = repeating()
    packed = bytearray(standalone.ENCODERS["gzip"](text.encode(), -1))
    packed[len(packed) // 2 - 1] ^= 255
    assert standalone.DECODERS["gzip"](bytes(packed)) == text.encode()
    lz4 = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id = 614").first().text
    spark.createDataFrame([(5, text), (614, lz4), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.format): r.found for r in QUERIES["corruption_detected"](spark, str(tmp_path)).collect()}
    assert got == {(5, "gzip"): True, (614, "lz4"): True, (3, "zstd"): True}
