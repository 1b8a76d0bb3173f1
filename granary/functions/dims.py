"""Fixed tables: codecs, formats, priorities and default speeds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codec name -> id in the container header.
CODECS = {"zlib": 1, "bzip2": 2, "lzma": 3, "zstd": 4, "lz4": 5, "snappy": 6}
# Estimated MB per second (MB = 1024 * 1024 bytes) where no measurement is known.
COMPRESS_MB_S = {"zlib": 200.0, "bzip2": 50.0, "lzma": 30.0, "zstd": 400.0, "lz4": 800.0, "snappy": 600.0}
DECOMPRESS_MB_S = {"zlib": 250.0, "bzip2": 60.0, "lzma": 40.0, "zstd": 500.0, "lz4": 900.0, "snappy": 700.0}
OTHER_MB_S = 200.0
# Strategy -> codecs by priority; any other strategy counts as balanced.
PRIORITY = {
    "balanced": ["zstd", "zlib", "lzma", "bzip2", "lz4", "snappy"],
    "fast": ["lz4", "snappy", "zstd", "zlib", "lzma", "bzip2"],
    "max_ratio": ["lzma", "zstd", "bzip2", "zlib", "lz4", "snappy"],
}
# Format -> file name extension, first bytes.
FORMATS = {
    "gzip": ("gz", b"\x1f\x8b"),
    "bzip2": ("bz2", b"BZ"),
    "container": ("comp", b"COMP"),
    "xz": ("xz", b"\xfd7zXZ\x00"),
    "zstd": ("zst", b"\x28\xb5\x2f\xfd"),
    "lz4": ("lz4", b"\x04\x22\x4d\x18"),
    "zip": ("zip", b"PK\x03\x04"),
    "7z": ("7z", b"7z\xbc\xaf\x27\x1c"),
    "tar": ("tar", b"ustar"),
}
TAR_OFFSET = 257
ARCHIVES = ("tar", "zip", "7z")
STANDALONE = ("gzip", "bzip2", "xz", "zstd", "lz4")
MB = 1024 * 1024


def lookup(table: dict, key: Column) -> Column:
    """The value of a small fixed table, null for other keys."""
    return F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def codecs(spark: SparkSession) -> DataFrame:
    rows = [(name, id_, True, True, COMPRESS_MB_S[name], DECOMPRESS_MB_S[name]) for name, id_ in CODECS.items()]
    return spark.createDataFrame(rows, "name string, id int, has_buffer boolean, has_stream boolean, comp_mb_s double, decomp_mb_s double")


def formats(spark: SparkSession) -> DataFrame:
    rows = [(name, ext, bytearray(magic), TAR_OFFSET if name == "tar" else 0, name in ARCHIVES) for name, (ext, magic) in FORMATS.items()]
    return spark.createDataFrame(rows, "name string, extension string, magic binary, offset int, is_archive boolean")


def archive_formats(spark: SparkSession) -> DataFrame:
    """What the readers and writers of archives can do. 7z is detected only."""
    return spark.createDataFrame([("tar", True, False), ("zip", False, True)], "name string, streaming boolean, compression boolean")
