"""The Python parts of the engine under names that SQL can call.

pack_blob(content, codec, level), unpack_blob(content, codec): struct<data, error> of the six codecs;
pack_file(content, format, level), unpack_file(content, format): the same of the single-file formats;
gzip_name(content): the name that a gzip file holds;
unpack_blob and unpack_file also take the most bytes to decode as a last argument;
archive_entries(content, kind, payload): a table function, one row for each entry of a tar or zip. What can't be read is a row with an error.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from granary.functions import codecs, standalone
from granary.functions.batches import blob_batches
from granary.operators.archive import ENTRY, _tar_entries, _zip_entries
from granary.sources import files


class ArchiveEntries:
    def eval(self, content: bytes, kind: str, payload: bool):
        if content is not None and kind in ("tar", "zip"):
            try:
                for ord_, path, type_, size, mtime, mode, link, raw in (_tar_entries if kind == "tar" else _zip_entries)(bytes(content), payload):
                    yield ord_, path, type_, size, None if mtime is None else mtime.to_pydatetime(), mode, link, raw, None
            except Exception as e:  # noqa: BLE001 - a damaged archive is a row
                yield *[None] * 8, f"{type(e).__name__}: {e}"


def register(spark: SparkSession) -> None:
    blob_batches(spark)
    for name, function in (("pack_blob", codecs.encode_udf), ("unpack_blob", codecs.decode_udf), ("pack_file", standalone.pack_udf), ("unpack_file", standalone.unpack_udf), ("gzip_name", standalone.original_name)):
        spark.udf.register(name, function)
    spark.udtf.register("archive_entries", udtf(ArchiveEntries, returnType=f"{ENTRY}, error string"))
    files.register(spark)
