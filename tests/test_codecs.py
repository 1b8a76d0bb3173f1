import bz2
import gzip
import lzma
import subprocess
import sys

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import codecs, formats, report, standalone
from granary.functions import header as H
from granary.operators import benchmark, container

BLOBS = [b"Hello, World! " * 100, bytes(range(256)) * 100, b"A" * 1_000_000, b"Hi!", b"", bytes(i * 137 % 256 for i in range(5000)), b"x" * 65536, b"y" * 65537]


@pytest.mark.parametrize("name", codecs.ENCODERS)
@settings(max_examples=25, deadline=None)
@given(data=st.binary(max_size=4000), level=st.integers(-1, 9))
def test_codec_roundtrip(name, data, level):
    assert codecs.DECODERS[name](codecs.ENCODERS[name](data, level), len(data)) == data


@pytest.mark.parametrize("name", codecs.ENCODERS)
def test_codec_blobs_and_truncation(name):
    for blob in BLOBS:
        packed = codecs.ENCODERS[name](blob, -1)
        assert codecs.DECODERS[name](packed) == blob
        if len(blob) > 100:
            with pytest.raises(Exception):  # noqa: B017
                assert codecs.DECODERS[name](packed[:-5]) == blob


@pytest.mark.parametrize("name", standalone.ENCODERS)
def test_files_and_their_checks(name):
    for blob in BLOBS:
        for level in (-1, 1, 9):
            assert standalone.DECODERS[name](standalone.ENCODERS[name](blob, level)) == blob
    packed = bytearray(standalone.ENCODERS[name](BLOBS[5], -1))
    packed[len(packed) // 2] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        assert standalone.DECODERS[name](bytes(packed)) == BLOBS[5]


def test_other_tools_read_the_files():
    blob = BLOBS[0]
    assert gzip.decompress(standalone.ENCODERS["gzip"](blob, 6)) == blob
    assert bz2.decompress(standalone.ENCODERS["bzip2"](blob, 9)) == blob
    assert lzma.decompress(standalone.ENCODERS["xz"](blob, 6)) == blob
    assert zstandard.ZstdDecompressor().decompress(standalone.ENCODERS["zstd"](blob, 3)) == blob
    assert standalone.gzip_name(gzip.compress(b"x")) is None


def test_gzip_name():
    import io

    out = io.BytesIO()
    with gzip.GzipFile("some.txt", "wb", fileobj=out) as f:
        f.write(b"x")
    assert standalone.gzip_name(out.getvalue()) == "some.txt"


def test_several_zstd_frames_and_first_gzip_member():
    z = zstandard.ZstdCompressor()
    assert codecs.zstd_decode(z.compress(b"a") + z.compress(b"b")) == b"ab"
    assert standalone.DECODERS["gzip"](gzip.compress(b"a") + gzip.compress(b"b")) == b"a"


@pytest.mark.parametrize("data,want", [("1f8b08", "gzip"), ("425a6839", "bzip2"), ("fd377a585a00", "xz"), ("28b52ffd", "zstd"), ("04224d18", "lz4"), ("504b0304", "zip"), ("434f4d50", "container"), ("377abcaf271c", "7z"), ("1f", "unknown"), ("", "unknown"), ("ffffffff", "unknown")])
def test_magic(spark, data, want):
    assert spark.range(1).select(formats.of_magic(F.lit(bytearray.fromhex(data)))).first()[0] == want


def test_short_blobs_are_unknown_whatever_the_path(spark):
    df = spark.createDataFrame([(bytearray(b"Hi!"), "x.gz"), (bytearray(b"Hi!!"), "x.gz"), (None, "x.gz")], "c binary, p string")
    assert [r[0] for r in df.select(formats.of_blob(F.col("c"), F.col("p"))).collect()] == ["unknown", "gzip", "gzip"]


def test_header_bytes(spark):
    import struct

    row = spark.range(1).select(H.header(F.lit("zlib"), F.lit(6), F.lit(1_000_000))).first()[0]
    assert bytes(row) == struct.pack("<4sBBBBQ", b"COMP", 1, 1, 6, 0, 1_000_000)


def test_pack_errors_are_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc"), "zstd", 3), (2, bytearray(b""), "zstd", 3), (3, bytearray(b"abc"), "nope", 3), (4, bytearray(b"abc"), "zlib", 23), (5, None, "zlib", 1)], "id int, content binary, codec string, level int")
    rows = {r.id: r for r in container.pack(df, F.col("codec"), F.col("level")).collect()}
    assert [rows[k].error for k in range(1, 6)] == [None, "ValueError: empty input", "ValueError: unknown codec nope", "ValueError: level 23 out of range", None]
    assert rows[1].packed is not None and all(rows[k].packed is None for k in range(2, 6))


def test_unpack_checks_the_size(spark):
    packed = container.pack(spark.createDataFrame([(bytearray(b"abc" * 50),)], "content binary"), F.lit("lz4")).select(F.col("packed").alias("content"))
    wrong = packed.select(F.concat(F.substring("content", 1, 8), F.lit(bytearray(b"\x07" + bytes(7))), F.expr("substring(content, 17)")).alias("content"))
    assert container.unpack(packed).first().error is None
    assert container.unpack(wrong).first().error == "HeaderError: size mismatch"
    assert bytes(container.unpack(wrong, lenient=True).first().data) == b"abc" * 50
    assert container.unpack(spark.createDataFrame([(bytearray(b"plain text"),)], "content binary")).first().error == "ValueError: unknown format"


@pytest.mark.parametrize("size,want", [(0, "0.00 B"), (500, "500.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (2**20, "1.00 MB"), (2**30, "1.00 GB"), (2**40, "1.00 TB"), (2**50, "1.00 PB")])
def test_format_size(spark, size, want):
    assert spark.range(1).select(report.format_size(F.lit(float(size)))).first()[0] == want


@pytest.mark.parametrize("seconds,want", [(0.5, "500ms"), (1.0, "1.00s"), (5.5, "5.50s"), (59.9, "59.90s"), (60.0, "1m 0.0s"), (90.5, "1m 30.5s"), (125.0, "2m 5.0s")])
def test_format_time(spark, seconds, want):
    assert spark.range(1).select(report.format_time(F.lit(seconds))).first()[0] == want


@pytest.mark.parametrize("row,want", [((1_000_000, 500_000, 1.0, 0.5), (0.5, None, None)), ((0, 100, 1.0, 0.5), (0.0, 0.0, 0.0)), ((1_048_576, 500_000, 1.0, 0.5), (None, 1.0, 2.0)), ((1_048_576, 1, 0.0, 0.5), (None, 0.0, 2.0)), ((2_097_152, 1, 1.0, 0.5), (None, 2.0, 4.0))])
def test_metrics(spark, row, want):
    df = spark.createDataFrame([row], "input_size long, compressed_size long, compress_time double, decompress_time double")
    got = benchmark.metrics(df).select("ratio", "comp_mb_s", "decomp_mb_s").first()
    assert all(w is None or g == w for g, w in zip(got, want))


def test_lists(spark):
    df = spark.createDataFrame([(" zlib, ,zstd ", "auto,3, 9"), ("ALL", "default")], "a string, n string")
    rows = df.select(report.names(F.col("a"), ["x", "y"]), report.levels(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(["zlib", "zstd"], [None, 3, 9]), (["x", "y"], [None])]


def test_rest_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['granary.llm'] = None; import __spark_entry__ as e; assert 'plan_compression' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


@pytest.mark.parametrize("name", list(codecs.ENCODERS))
def test_decoders_stop_at_their_limit(name):
    bomb = codecs.ENCODERS[name](bytes(5_000_000), -1)
    assert len(codecs.DECODERS[name](bomb, 5_000_000)) == 5_000_000
    with pytest.raises(ValueError, match="decodes to more"):
        codecs.DECODERS[name](bomb, 4_999_999)


@pytest.mark.parametrize("name", list(standalone.ENCODERS))
def test_single_files_stop_at_their_limit(name):
    bomb = standalone.ENCODERS[name](bytes(5_000_000), -1)
    assert len(standalone.DECODERS[name](bomb, 5_000_000)) == 5_000_000
    with pytest.raises(ValueError, match="decodes to more"):
        standalone.DECODERS[name](bomb, 1000)


def test_a_smaller_dictionary_packs_the_same():
    import lzma
    import random

    rnd = random.Random(1)
    for size in (0, 1, 4095, 4097, 30_000, 200_000, 300_000):
        data = bytes(rnd.choice(b"abcdef ") for _ in range(size))
        small, large = codecs.ENCODERS["lzma"](data, 6), lzma.compress(data, check=lzma.CHECK_CRC64, preset=6 | lzma.PRESET_EXTREME)
        assert codecs.DECODERS["lzma"](small, size) == data and abs(len(small) - len(large)) <= 4


def test_names_in_cut_headers():
    head = b"\x1f\x8b\x08"
    whole = head + b"\x0c" + bytes(6) + b"\x02\x00xx" + b"name\0rest"
    assert standalone.gzip_name(whole) == "name"
    assert all(standalone.gzip_name(whole[:n]) is None for n in range(19))


@pytest.mark.parametrize("size", [0, 1, 100, 65_535, 65_536, 65_537, 1_000_000])
def test_lz4_keeps_its_bound(size):
    import os

    assert len(codecs.ENCODERS["lz4"](os.urandom(size), -1)) <= size + size // 255 + 19 + 4 * -(-size // 65536)
