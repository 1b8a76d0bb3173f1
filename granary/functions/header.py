"""The container's 16-byte header: COMP, version, codec id, level, flags, original size (64-bit, little-endian)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.dims import CODECS, DECOMPRESS_MB_S, MB, OTHER_MB_S, lookup

MAGIC, VERSION, SIZE, AUTO_LEVEL = b"COMP", 1, 16, 255
MAX_SIZE = (1 << 63) - 1


def _swapped(hexed: Column, width: int) -> Column:
    """Hex digits of `width` bytes in reverse byte order."""
    return F.regexp_replace(hexed, "(..)" * width, "".join(f"${k}" for k in range(width, 0, -1)))


def read_le(content: Column, position: int, width: int) -> Column:
    """The unsigned little-endian number at a 1-based position, as a decimal."""
    return F.conv(_swapped(F.hex(F.substring(content, position, width)), width), 16, 10).cast("decimal(20,0)")


def write_le(number: Column, width: int) -> Column:
    return F.unhex(_swapped(F.lpad(F.hex(number.cast("long")), 2 * width, "0"), width))


def _byte(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2, "0"))


def header(codec: Column, level: Column, size: Column) -> Column:
    """Header bytes. Levels outside 0 to 254 are stored as 255, which means the codec's default."""
    stored = F.when(level.between(0, 254), level).otherwise(F.lit(AUTO_LEVEL))
    return F.concat(F.lit(bytearray(MAGIC + bytes([VERSION]))), _byte(lookup(CODECS, codec)), _byte(stored), F.lit(bytearray(1)), write_le(size, 8))


def inspect(content: Column) -> Column:
    """What a blob's header says, as a struct; reason tells why it can't be decompressed, and unread fields are null.

    A wrong version counts as no container at all; a size above 2^63 - 1 as a container with a bad header.
    An empty blob's estimate is 0 seconds, as when it is packed.
    """
    version, algo, level, flags = (read_le(content, k, 1).cast("int") for k in (5, 6, 7, 8))
    size = read_le(content, 9, 8)
    short, magic = F.octet_length(content) < SIZE, F.substring(content, 1, 4) == F.lit(bytearray(MAGIC))
    named = F.element_at(F.map_from_arrays(F.array(*map(F.lit, CODECS.values())), F.array(*map(F.lit, CODECS))), algo)
    reason = (
        F.when(short, f"shorter than the {SIZE} bytes of a header")
        .when(~magic, "magic bytes of no container")
        .when(version != VERSION, F.concat(F.lit("version "), version.cast("string"), F.lit(" not known")))
        .when(size > MAX_SIZE, F.concat(F.lit("claims "), size.cast("string"), F.lit(f" bytes, more than {MAX_SIZE}")))
    )
    ok = reason.isNull()
    known = ok & named.isNotNull()
    speed = F.coalesce(lookup(DECOMPRESS_MB_S, named), F.lit(OTHER_MB_S))
    when = lambda value: F.when(ok, value)
    return F.struct(
        F.coalesce(~short & magic & (version == VERSION), F.lit(False)).alias("is_container"),
        ok.alias("header_ok"),
        F.coalesce(reason, F.when(named.isNull(), "names no codec")).alias("reason"),
        when(version).alias("version"),
        when(algo).alias("algo_id"),
        when(named).alias("algo_name"),
        when(F.nullif(level, F.lit(AUTO_LEVEL))).alias("level"),
        when(flags).alias("flags"),
        when(size.cast("long")).alias("orig_size"),
        known.alias("backend_available"),
        known.alias("has_streaming"),
        known.alias("can_decompress"),
        F.when(known, size.cast("double") / (speed * MB)).alias("estimated_decomp_s"),
    )
