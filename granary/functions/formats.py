"""Format detection and the algebra of pipelines (an archive, a codec or both) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.dims import ARCHIVES, CODECS, FORMATS, PRIORITY, STANDALONE, TAR_OFFSET, lookup

UNKNOWN = "unknown"
# Extensions beside the formats' own, and names beside them.
OTHER_EXTENSIONS = {"zstd": "zstd", "tgz": "gzip", "tbz2": "bzip2", "txz": "xz", "tzst": "zstd", "tlz4": "lz4"}
SHORT_TAR = {"tgz": "gzip", "tbz2": "bzip2", "txz": "xz", "tzst": "zstd", "tlz4": "lz4"}
OTHER_NAMES = {"gz": "gzip", "bz2": "bzip2", "lzma": "xz", "zst": "zstd"}
_EXTENSIONS = {ext: name for name, (ext, _) in FORMATS.items()} | OTHER_EXTENSIONS
_NAMES = {name: name for name in FORMATS} | OTHER_NAMES


def of_magic(content: Column) -> Column:
    """Format by the first bytes, without tar. Two bytes suffice for gzip and bzip2, so text that begins with BZ is taken for bzip2."""
    expr = F.lit(UNKNOWN)
    for name, (_, magic) in reversed([x for x in FORMATS.items() if x[0] != "tar"]):
        expr = F.when(F.substring(content, 1, len(magic)) == F.lit(bytearray(magic)), name).otherwise(expr)
    return expr


def of_extension(path: Column) -> Column:
    """Format by what follows the last dot, of which case is ignored; a shorthand like tgz gives its codec."""
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(F.instr(path, ".") > 0, F.coalesce(lookup(_EXTENSIONS, ext), F.lit(UNKNOWN))).otherwise(UNKNOWN)


def of_blob(content: Column, path: Column) -> Column:
    """Format by magic, then by tar's mark, then by extension. Fewer than four bytes are unknown whatever the path."""
    magic = of_magic(content)
    tar = FORMATS["tar"][1]
    is_tar = F.substring(content, TAR_OFFSET + 1, len(tar)) == F.lit(bytearray(tar))
    return F.when(F.octet_length(content) < 4, UNKNOWN).when(magic != UNKNOWN, magic).when(is_tar, "tar").otherwise(of_extension(path))


def is_archive(fmt: Column) -> Column:
    return fmt.isin(*ARCHIVES)


def operation_mode(fmt: Column) -> Column:
    return F.when(is_archive(fmt), "archive").otherwise("single")


def archive_of(fmt: Column) -> Column:
    return F.when(is_archive(fmt), fmt).otherwise("none")


def codec_extension(codec: Column) -> Column:
    return lookup({name: FORMATS[name][0] for name in STANDALONE}, codec)


def of_name(name: Column) -> Column:
    """Format by its name or an alias, case-sensitive."""
    return F.coalesce(lookup(_NAMES, name), F.lit(UNKNOWN))


def wraps_tar(path: Column) -> Column:
    """Whether the name says that a codec wraps a tar: a shorthand, or a component .tar (lower case, not leading) before the extension."""
    return F.lower(F.substring_index(path, ".", -1)).isin(*SHORT_TAR) & (F.instr(path, ".") > 0) | path.rlike(r"(?s)^.+\.tar\.[^.]*$")


def _pipeline(archive: Column, codec: Column) -> Column:
    return F.struct(archive.alias("archive"), codec.alias("codec"))


def pipeline_of_name(name: Column) -> Column:
    """struct<archive, codec> of a name like tar.gz, tgz, zip or zstd; (none, unknown) for others."""
    base, rest = F.substring_index(name, ".", 1), F.regexp_replace(name, r"^[^.]*\.", "")
    dotted = (F.instr(name, ".") > 0) & (F.length(base) < 16) & is_archive(of_name(base)) & of_name(rest).isin(*STANDALONE)
    fmt = of_name(name)
    single = _pipeline(archive_of(fmt), F.when(is_archive(fmt), UNKNOWN).otherwise(fmt))
    short = lookup(SHORT_TAR, name)
    return F.when(dotted, _pipeline(of_name(base), of_name(rest))).when(short.isNotNull(), _pipeline(F.lit("tar"), short)).otherwise(single)


def pipeline_of_blob(content: Column, path: Column) -> Column:
    """struct<archive, codec>: an archive by its own mark, a tar inside a codec by the name (the content isn't decoded)."""
    fmt = of_blob(content, path)
    inner = F.when(fmt.isin(*STANDALONE) & wraps_tar(path), "tar").otherwise("none")
    return F.when(is_archive(fmt), _pipeline(fmt, F.lit(UNKNOWN))).otherwise(_pipeline(inner, fmt))


def display_name(pipeline: Column) -> Column:
    archive, codec = pipeline["archive"], pipeline["codec"]
    ext = codec_extension(codec)
    return F.when((archive != "none") & ext.isNotNull(), F.concat(archive, F.lit("."), ext)).when(archive != "none", archive).otherwise(codec)


def is_valid(pipeline: Column) -> Column:
    """A pipeline does something, zip takes no codec, and a codec is a standalone format."""
    archive, codec = pipeline["archive"], pipeline["codec"]
    return ((archive != "none") | (codec != UNKNOWN)) & ~((archive == "zip") & (codec != UNKNOWN)) & ((codec == UNKNOWN) | codec.isin(*STANDALONE))


def supports_archive(name: Column) -> Column:
    """Plain codecs by name can't hold several files."""
    return ~F.lower(name).isin("gz", "gzip", "bz2", "bzip2", "xz", "zst", "zstd", "lz4")


def strategy_of(name: Column) -> Column:
    return F.when(name.isin("fast", "max_ratio"), name).otherwise("balanced")


def codec_id(name: Column) -> Column:
    """Id by exact name, 0 for none."""
    return F.coalesce(lookup(CODECS, name), F.lit(0))


def codec_for(strategy: Column) -> Column:
    """The first codec of the strategy's priority."""
    return lookup({s: names[0] for s, names in PRIORITY.items()}, strategy_of(strategy))
