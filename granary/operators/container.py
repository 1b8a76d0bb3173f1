"""Packing tables of blobs into containers and getting any known format back.

Blobs are rows (path, content). Nothing here shuffles: every row is packed or unpacked where it is read, by one UDF that dispatches on
the row's format. codecs.spread() deals a table of few splits over tasks first, where that pays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import codecs, formats, standalone
from granary.functions.batches import blob_batches
from granary.functions import header as H
from granary.functions.dims import CODECS, STANDALONE

LEAST_LEVEL, MOST_LEVEL = -1, 22


def request_error(codec: Column, level: Column, size: Column, empty: bool = False) -> Column:
    """Why a blob can't be packed as asked; null if it can. Blobs of no bytes are refused unless `empty`."""
    return (
        F.when(~codec.isin(*CODECS), F.concat(F.lit("ValueError: unknown codec "), codec))
        .when(~level.between(LEAST_LEVEL, MOST_LEVEL), F.concat(F.lit("ValueError: level "), level.cast("string"), F.lit(" out of range")))
        .when(F.lit(not empty) & (size == 0), "ValueError: empty input")
        .when(size > codecs.MAX_BLOB, "ValueError: input too large")
    )


def error_class(error: Column) -> Column:
    """header, backend, value or io, by what an error text begins with; null without an error."""
    known = F.create_map(*(F.lit(x) for pair in (("HeaderError", "header"), ("BackendError", "backend"), ("OSError", "io"), ("FileExistsError", "io"), ("EOFError", "io")) for x in pair))
    return F.when(error.isNotNull(), F.coalesce(F.try_element_at(known, F.regexp_extract(error, "^([A-Za-z_.]+):", 1)), F.lit("value")))


def pack(blobs: DataFrame, codec: Column, level: Column | None = None, content: str = "content", out: str = "packed", empty: bool = False) -> DataFrame:
    """blobs with `out` (header and payload, null on failure), `error` and `error_class`. Null content stays null without an error; content of no bytes is one unless `empty`."""
    blob_batches(blobs.sparkSession)
    level = F.lit(-1) if level is None else level
    raw = F.col(content).cast("binary")
    rows = blobs.withColumn("__error", F.when(raw.isNotNull(), request_error(codec, level, F.octet_length(raw), empty)))
    rows = rows.withColumn("__r", codecs.compress(F.when(F.col("__error").isNull(), raw), codec, level))
    head = H.header(codec, level, F.octet_length(raw))
    rows = rows.withColumns({out: F.when(F.col("__r.data").isNotNull(), F.concat(head, F.col("__r.data"))), "error": F.coalesce("__error", "__r.error")})
    return rows.withColumn("error_class", error_class(F.col("error"))).drop("__r", "__error")


def unpack(blobs: DataFrame, path: Column | None = None, content: str = "content", out: str = "data", codec: Column | None = None, lenient: bool = False, most: int = codecs.MAX_DECODED, empty: bool = False) -> DataFrame:
    """blobs with `format`, `out` (null on failure), `error` and `error_class`, whatever known format each row has.

    The format is told by the bytes, then by the path. An archive is no single file, so it is an error here. `codec` overrides
    what a container's header names. Unless lenient, a container whose payload doesn't have the header's size is an error; decoding
    stops at that size, and anywhere at `most` bytes. A container whose header says 0 bytes is an error unless `empty`.
    """
    blob_batches(blobs.sparkSession)
    raw = F.col(content)
    rows = blobs.withColumn("format", formats.of_blob(raw, F.lit("") if path is None else path))
    # plain columns instead of a struct, which the optimizer would take apart and repeat at each use
    head = H.inspect(raw)
    rows = rows.withColumns({"__ok": head["header_ok"], "__reason": head["reason"], "__size": head["orig_size"], "__name": head["algo_name"]})
    boxed, single = F.col("format") == "container", F.col("format").isin(*STANDALONE)
    named = F.col("__name") if codec is None else F.coalesce(codec, F.col("__name"))
    error = (
        F.when(boxed & ~F.col("__ok"), F.concat(F.lit("HeaderError: "), F.col("__reason")))
        .when(F.lit(not empty) & boxed & (F.col("__size") == 0), "HeaderError: original size is 0")
        .when(boxed & named.isNull(), F.concat(F.lit("BackendError: "), F.col("__reason")))
        .when(formats.is_archive(F.col("format")), F.concat(F.lit("ValueError: archive, extract it: "), F.col("format")))
        .when(~boxed & ~single, "ValueError: unknown format")
    )
    rows = rows.withColumn("__error", F.when(raw.isNotNull(), error))
    good = F.col("__error").isNull()
    payload = F.expr(f"substring(`{content}`, {H.SIZE + 1})")
    kind = F.when(boxed, F.concat(F.lit("container/"), named)).otherwise(F.col("format"))
    claimed = F.lit(False) if lenient else boxed & (F.col("__size") <= most)
    limit = F.when(claimed, F.col("__size")).otherwise(F.lit(most))
    rows = rows.withColumn("__r", standalone.unpack_any_udf(F.when(good, F.when(boxed, payload).otherwise(raw)), kind, limit.cast("long")))
    wrong = F.coalesce(claimed & ((F.octet_length("__r.data") != F.col("__size")) | F.col("__r.error").startswith("ValueError: decodes to more")), F.lit(False))
    failed = F.coalesce("__error", F.when(wrong, "HeaderError: size mismatch"), "__r.error")
    return rows.withColumns({out: F.when(~wrong, F.col("__r.data")), "error": failed}).withColumn("error_class", error_class(F.col("error"))).drop("__ok", "__reason", "__size", "__name", "__error", "__r")


def inspect(blobs: DataFrame, content: str = "content") -> DataFrame:
    """blobs with the fields of the header. Only the first bytes of content matter, so a table of prefixes does."""
    return blobs.withColumn("__h", H.inspect(F.col(content))).select(*blobs.columns, "__h.*")
