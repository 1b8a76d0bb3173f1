"""Numbers and texts of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.dims import MB


def ratio(compressed: Column, size: Column) -> Column:
    return F.when(size != 0, compressed / size).otherwise(0.0)


def mb_per_s(size: Column, seconds: Column) -> Column:
    return F.when(seconds != 0, size / MB / seconds).otherwise(0.0)


def saved_bytes(compressed: Column, size: Column) -> Column:
    """Bytes that packing saves; negative where it adds some."""
    return size - compressed


def saved_percent(compressed: Column, size: Column) -> Column:
    return (1 - ratio(compressed, size)) * 100


def format_size(size: Column) -> Column:
    """Bytes with two decimals in B to PB, in steps of 1024."""
    units = ["B", "KB", "MB", "GB", "TB"]
    expr = F.concat(F.format_string("%.2f", size / 1024.0**5), F.lit(" PB"))
    for k in range(len(units) - 1, -1, -1):
        expr = F.when(size < 1024.0 ** (k + 1), F.concat(F.format_string("%.2f", size / 1024.0**k), F.lit(f" {units[k]}"))).otherwise(expr)
    return expr


def format_time(seconds: Column) -> Column:
    """Milliseconds below a second, seconds below a minute, minutes and seconds from there."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 1, F.concat(F.format_string("%.0f", seconds * 1000.0), F.lit("ms")))
        .when(seconds < 60, F.concat(F.format_string("%.2f", seconds), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), F.format_string("%.1f", seconds - minutes * 60), F.lit("s")))
    )


def compressed_path(path: Column) -> Column:
    return F.concat(path, F.lit(".comp"))


def decompressed_path(path: Column) -> Column:
    """The path without its last suffix, or with .out if it has none. A leading dot begins no suffix."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.when(bare == path, F.concat(path, F.lit(".out"))).otherwise(bare)


def names(text: Column, everything: list[str]) -> Column:
    """A list from a comma-separated text: trimmed, blanks dropped; all gives everything."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(F.trim(text)) == "all", F.array(*map(F.lit, everything))).otherwise(parts)


def levels(text: Column) -> Column:
    """Levels from a comma-separated text; auto and default give null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(~x.isin("auto", "default"), x.cast("int")))
