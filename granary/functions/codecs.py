"""The six codecs as Arrow-batched UDFs. A failure is a value: struct<data, error>, so that one bad blob fails no job.

What a blob decodes to is bounded too: decoders stop at a limit, so that a few bytes that claim gigabytes are an error row.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterable
from itertools import repeat

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

RESULT = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])
#: Raw bytes in a block of framed snappy, and the memory that decoding xz may take.
BLOCK, LZMA_MEMORY = 65536, 512 << 20
#: Packed bytes that go into a zstd decoder at once; each can become 128 KiB at most.
STEP = 1 << 14
#: Decoded bytes that are asked of an lz4 stream at once.
READ_STEP = 1 << 18
#: A blob is one value of a column, and those end at 2 GiB.
MAX_BLOB = (1 << 31) - 1
#: Bytes that a blob may decode to unless a caller says otherwise; a batch of them must fit in a worker and in one Arrow column.
MAX_DECODED = 1 << 30
#: The smallest dictionary of lzma.
LEAST_DICTIONARY = 4096


def complete(decoder, data: bytes, most: int) -> bytes:
    """What a decoder with a limit per call makes of data, which must be a whole stream."""
    out = decoder.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError(f"decodes to more than {most} bytes")
    if not decoder.eof:
        raise ValueError("truncated stream")
    return out


def read_all(stream, most: int) -> bytes:
    out = stream.read(most + 1)
    if len(out) > most:
        raise ValueError(f"decodes to more than {most} bytes")
    return out


def snappy_frames(data: bytes) -> bytes:
    """Blocks of raw length, packed length (little-endian, 32 bits each) and raw snappy, without an end mark."""
    out = []
    for at in range(0, len(data), BLOCK):
        raw = data[at : at + BLOCK]
        packed = pa.compress(raw, codec="snappy", asbytes=True)
        out += [struct.pack("<II", len(raw), len(packed)), packed]
    return b"".join(out)


def snappy_unframe(data: bytes, most: int = MAX_DECODED) -> bytes:
    out, at, total = [], 0, 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("truncated stream")
        size, packed = struct.unpack_from("<II", data, at)
        at += 8
        if not size and not packed:
            break
        if size > BLOCK or at + packed > len(data):
            raise ValueError("bad snappy block")
        total += size
        if total > most:
            raise ValueError(f"decodes to more than {most} bytes")
        raw = pa.decompress(data[at : at + packed], decompressed_size=size, codec="snappy", asbytes=True)
        if len(raw) != size:
            raise ValueError("bad snappy block")
        out.append(raw)
        at += packed
    return b"".join(out)


def zstd_decode(data: bytes, most: int = MAX_DECODED) -> bytes:
    """All frames, of which there must be one, and each must be complete."""
    if not data:
        raise ValueError("truncated stream")
    out, total = [], 0
    while data:
        decoder = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
        for at in range(0, len(data), STEP):
            out.append(decoder.decompress(data[at : at + STEP]))
            total += len(out[-1])
            if total > most:
                raise ValueError(f"decodes to more than {most} bytes")
            if decoder.eof:
                break
        if not decoder.eof:
            raise ValueError("truncated stream")
        data = decoder.unused_data + data[at + STEP :]
    return b"".join(out)


def lz4_encode(data: bytes, level: int) -> bytes:
    codec = pa.Codec("lz4", compression_level=min(level, 12)) if level > 0 else pa.Codec("lz4")
    return codec.compress(data, asbytes=True)


def lz4_decode(data: bytes, most: int = MAX_DECODED) -> bytes:
    if not data:
        raise ValueError("truncated stream")
    out, total = [], 0
    with pa.CompressedInputStream(pa.BufferReader(data), "lz4") as stream:
        # in steps: a read sets aside all that it asks for, and keeps it if the stream is damaged
        while piece := stream.read(min(READ_STEP, most + 1 - total)):
            out.append(piece)
            total += len(piece)
            if total > most:
                raise ValueError(f"decodes to more than {most} bytes")
    return b"".join(out)


def lzma_filters(size: int, level: int, extreme: bool) -> list[dict]:
    """The preset's filter with a dictionary no larger than the data needs; a smaller one packs the same and is much cheaper to set up."""
    preset = (6 if level < 0 else min(level, 9)) | (lzma.PRESET_EXTREME if extreme else 0)
    dictionary = max(LEAST_DICTIONARY, 1 << max(0, size - 1).bit_length())
    return [{"id": lzma.FILTER_LZMA2, "preset": preset} | ({"dict_size": dictionary} if dictionary < 1 << 18 else {})]


def bzip2_level(size: int, level: int) -> int:
    """Blocks of level * 100,000 bytes; more than the data fill changes only the cost."""
    return min(level if 1 <= level <= 9 else 9, max(1, -(-size // 90_000)))


ENCODERS: dict[str, Callable[[bytes, int], bytes]] = {
    "zlib": lambda x, n: zlib.compress(x, n if 0 <= n <= 9 else -1),
    "bzip2": lambda x, n: bz2.compress(x, bzip2_level(len(x), n)),
    "lzma": lambda x, n: lzma.compress(x, check=lzma.CHECK_CRC64, filters=lzma_filters(len(x), n, True)),
    "zstd": lambda x, n: zstandard.ZstdCompressor(level=3 if n < 0 else min(n, 22)).compress(x),
    "lz4": lz4_encode,
    "snappy": lambda x, _: snappy_frames(x),
}
DECODERS: dict[str, Callable[[bytes, int], bytes]] = {
    "zlib": lambda x, most=MAX_DECODED: complete(zlib.decompressobj(), x, most),
    "bzip2": lambda x, most=MAX_DECODED: complete(bz2.BZ2Decompressor(), x, most),
    "lzma": lambda x, most=MAX_DECODED: complete(lzma.LZMADecompressor(memlimit=LZMA_MEMORY), x, most),
    "zstd": zstd_decode,
    "lz4": lz4_decode,
    "snappy": snappy_unframe,
}


def attempt(function: Callable[[], bytes]) -> tuple[bytes | None, str | None]:
    try:
        return function(), None
    except Exception as e:  # noqa: BLE001 - whatever a codec raises becomes the row's error
        return None, f"{type(e).__name__}: {e}"


def _apply(table, name, *args):
    if any(a is None for a in args[:1]):
        return None, None
    if name not in table:
        return None, f"no backend for {name}"
    return attempt(lambda: table[name](*args))


@pandas_udf(RESULT)
def encode_udf(content: pd.Series, codec: pd.Series, level: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_apply(ENCODERS, c, x, -1 if pd.isna(n) else int(n)) for x, c, n in zip(content, codec, level)], columns=RESULT.names)


def _limits(most: pd.Series | None) -> Iterable[int]:
    """The limit of each row; a null one is the default, and none is above what a value can hold."""
    return repeat(MAX_DECODED) if most is None else [MAX_DECODED if pd.isna(m) else max(0, min(int(m), MAX_BLOB)) for m in most]


@pandas_udf(RESULT)
def decode_udf(content: pd.Series, codec: pd.Series, most: pd.Series = None) -> pd.DataFrame:
    return pd.DataFrame([_apply(DECODERS, c, x, m) for x, c, m in zip(content, codec, _limits(most))], columns=RESULT.names)


def compress(content: Column, codec: Column | str, level: Column | int = -1) -> Column:
    """struct<data, error>: content packed by the row's codec. -1 is the codec's default level."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return encode_udf(content.cast("binary"), lit(codec), lit(level).cast("int"))


def decompress(content: Column, codec: Column | str, most: Column | int = MAX_DECODED) -> Column:
    """struct<data, error>: a truncated or damaged stream gives an error, and so does one of more than `most` decoded bytes."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return decode_udf(content, lit(codec), lit(most).cast("long"))


def spread(blobs: DataFrame) -> DataFrame:
    """blobs dealt over a task for each core, if their scan has at most half as many splits; else as they are.

    That is one shuffle of the blobs, worth it before a codec that is slower than a shuffle. A table of many splits, as at scale, never moves. For
    scans: a plan with a shuffle of its own would run up to it to count its splits.
    """
    cores = blobs.sparkSession.sparkContext.defaultParallelism
    return blobs.repartition(cores) if 2 * blobs.rdd.getNumPartitions() <= cores else blobs


def effective_level(codec: Column, level: Column) -> Column:
    """The level that a codec makes of the one asked for."""
    return (
        F.when(codec == "bzip2", F.when(level.between(1, 9), level).otherwise(9))
        .when(codec == "lzma", F.when(level < 0, 6).otherwise(F.least(level, F.lit(9))))
        .when(codec == "zstd", F.when(level < 0, 3).otherwise(F.least(level, F.lit(22))))
        .when(codec == "lz4", F.greatest(level, F.lit(0)))
        .when(codec == "zlib", F.when(level.between(0, 9), level).otherwise(-1))
        .otherwise(level)
    )


def max_compressed_size(codec: Column, size: Column) -> Column:
    """The most bytes that a codec makes of `size` bytes."""
    n = size.cast("long")
    part = lambda k: F.floor(n / k)
    return (
        F.when(codec == "zlib", n + part(4096) + part(16384) + part(33554432) + 13)
        .when(codec == "bzip2", n + part(100) + 600)
        .when(codec == "lzma", n + part(3) + 131072)
        .when(codec == "zstd", n + part(256) + F.when(n < 131072, F.floor((131072 - n) / 2048)).otherwise(0))
        .when(codec == "lz4", n + part(255) + 19 + 4 * F.ceil(n / 65536))
        .when(codec == "snappy", 32 + n + part(6))
    )
