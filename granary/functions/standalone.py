"""Single-file formats as UDFs: gzip, bzip2, xz, zstd and lz4 as other tools read them, with their checksums."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.functions import codecs
from granary.functions.codecs import LZMA_MEMORY, MAX_DECODED, RESULT, _apply, _limits, bzip2_level, complete, lz4_decode, lz4_encode, lzma_filters, zstd_decode
from granary.functions.header import read_le


def gzip_encode(data: bytes, level: int) -> bytes:
    """No name, no time, so equal data give equal files."""
    deflate = zlib.compressobj(level if 0 <= level <= 9 else -1, zlib.DEFLATED, -15)
    head = b"\x1f\x8b\x08" + bytes(6) + b"\x03"
    return head + deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def lz4_file(data: bytes, level: int) -> bytes:
    """A frame with checksums of its blocks and of its content: the flags are set, the header's own check byte made anew, the checksums added.

    A damaged block can still decode to the same content, where text repeats; only a checksum of its packed bytes tells.
    """
    frame = lz4_encode(data, level)
    head = bytearray(frame[: 7 + 8 * bool(frame[4] & 1 << 3) + 4 * bool(frame[4] & 1)])
    head[4] |= 1 << 4 | 1 << 2
    head[-1] = xxhash.xxh32(bytes(head[4:-1])).intdigest() >> 8 & 0xFF
    out, at = [bytes(head)], len(head)
    while size := int.from_bytes(frame[at : at + 4], "little") & 0x7FFFFFFF:
        end = at + 4 + size
        out += [frame[at:end], struct.pack("<I", xxhash.xxh32(frame[at + 4 : end]).intdigest())]
        at = end
    return b"".join([*out, bytes(4), struct.pack("<I", xxhash.xxh32(data).intdigest())])


def gzip_name(data: bytes) -> str | None:
    """The file name that a gzip header may hold; none in a header that is cut off."""
    if data[:2] != b"\x1f\x8b" or len(data) < 10 or not data[3] & 8:
        return None
    at = 10
    if data[3] & 4:
        if len(data) < 12:
            return None
        at += 2 + int.from_bytes(data[10:12], "little")
    end = data.find(b"\0", at)
    return data[at:end][:255].decode("latin-1") if end >= 0 else None


ENCODERS = {
    "gzip": gzip_encode,
    "bzip2": lambda x, n: bz2.compress(x, bzip2_level(len(x), n)),
    "xz": lambda x, n: lzma.compress(x, check=lzma.CHECK_CRC64, filters=lzma_filters(len(x), n, False)),
    "zstd": lambda x, n: zstandard.ZstdCompressor(level=3 if n < 0 else min(n, 22), write_checksum=True).compress(x),
    "lz4": lz4_file,
}
DECODERS = {
    "gzip": lambda x, most=MAX_DECODED: complete(zlib.decompressobj(31), x, most),
    "bzip2": lambda x, most=MAX_DECODED: complete(bz2.BZ2Decompressor(), x, most),
    "xz": lambda x, most=MAX_DECODED: complete(lzma.LZMADecompressor(memlimit=LZMA_MEMORY), x, most),
    "zstd": zstd_decode,
    "lz4": lz4_decode,
}


@pandas_udf(RESULT)
def pack_udf(content: pd.Series, fmt: pd.Series, level: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_apply(ENCODERS, f, x, -1 if pd.isna(n) else int(n)) for x, f, n in zip(content, fmt, level)], columns=RESULT.names)


@pandas_udf(RESULT)
def unpack_udf(content: pd.Series, fmt: pd.Series, most: pd.Series = None) -> pd.DataFrame:
    return pd.DataFrame([_apply(DECODERS, f, x, m) for x, f, m in zip(content, fmt, _limits(most))], columns=RESULT.names)


#: Every decoder by one name: single-file formats by theirs, a container's codecs as container/<codec>.
ANY = DECODERS | {f"container/{name}": decode for name, decode in codecs.DECODERS.items()}


@pandas_udf(RESULT)
def unpack_any_udf(content: pd.Series, kind: pd.Series, most: pd.Series = None) -> pd.DataFrame:
    return pd.DataFrame([_apply(ANY, k, x, m) for x, k, m in zip(content, kind, _limits(most))], columns=RESULT.names)


@pandas_udf(T.StringType())
def original_name(content: pd.Series) -> pd.Series:
    """The name that a gzip file holds, null for others."""
    return pd.Series([gzip_name(x) if x is not None else None for x in content], dtype=object)


def pack(content: Column, fmt: Column | str, level: Column | int = -1) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return pack_udf(content.cast("binary"), lit(fmt), lit(level).cast("int"))


def unpack(content: Column, fmt: Column | str, most: Column | int = MAX_DECODED) -> Column:
    """struct<data, error>: a truncated or damaged file gives an error, and so does one of more than `most` decoded bytes."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return unpack_udf(content, lit(fmt), lit(most).cast("long"))


def effective_level(fmt: Column, level: Column) -> Column:
    """The level that pack() uses."""
    return (
        F.when(fmt == "bzip2", F.when(level.between(1, 9), level).otherwise(9))
        .when(fmt == "xz", F.when(level < 0, 6).otherwise(F.least(level, F.lit(9))))
        .when(fmt == "zstd", F.when(level < 0, 3).otherwise(F.least(level, F.lit(22))))
        .when(fmt == "lz4", F.greatest(level, F.lit(0)))
        .when(fmt == "gzip", F.when(level.between(0, 9), level).otherwise(-1))
    )


def gzip_trailer(content: Column) -> Column:
    """struct<crc32, size>: what the last eight bytes of a gzip file claim of its content, read without unpacking it."""
    tail = F.right(F.hex(content), F.lit(16))
    number = lambda at: read_le(F.unhex(F.substring(tail, at, 8)), 1, 4).cast("long")
    return F.struct(number(1).alias("crc32"), number(9).alias("size"))
