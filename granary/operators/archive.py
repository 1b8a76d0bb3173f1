"""Archives as tables: rows of entries are folded into tar or zip blobs, and blobs are read back as rows of entries.

An archive is one value, so its entries meet in one task. Folders of any size therefore go into volumes, each an archive with its own
row: a key has one for every VOLUME_BYTES of its entries, and a hash of their path deals the entries over them.
"""

from __future__ import annotations

import hashlib
import io
import stat
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import codecs, formats, standalone
from granary.functions.batches import blob_batches
from granary.functions.dims import STANDALONE
from granary.operators import policy

ENTRY = "ord int, path string, type string, size long, mtime timestamp, mode int, link_target string, content binary"
_EPOCH = (1980, 1, 1, 0, 0, 0)
#: Bytes of entries for each volume of a key, and what an entry weighs beside its content and path. A worker holds a volume several times over.
VOLUME_BYTES, ENTRY_BYTES = 8 << 20, 1024


def volume_of(path: Column, volumes: Column | int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(volumes)).cast("int")


def volumes_of(entries: DataFrame, key: str = "key", volume_bytes: int | None = None) -> DataFrame:
    """key, volumes of the keys that need more than one volume: a row for each volume_bytes of all entries at most, so this is small.

    The bytes of an entry are its column `size`, where there is one, else those of its content.
    """
    size = F.col("size") if "size" in entries.columns else F.octet_length("content")
    weight = F.coalesce(size, F.lit(0)).cast("long") + F.octet_length("path") + ENTRY_BYTES
    sizes = entries.groupBy(key, "path").agg(F.max(weight).alias("n")).groupBy(key).agg(F.sum("n").alias("n"))
    return sizes.select(key, F.ceil(F.col("n") / F.lit(volume_bytes or VOLUME_BYTES)).cast("int").alias("volumes")).filter("volumes > 1")


def last_written(entries: DataFrame, keys: list[str], order: Column, path: str = "path") -> DataFrame:
    """Of the entries of a key with one path, the last by `order`."""
    last = Window.partitionBy(*keys, path).orderBy(order.desc())
    return entries.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def stored_path(path: Column, base: Column | None = None) -> Column:
    """The path under which a file is stored: below its folder's own name if it was added with a folder, else as given."""
    if base is None:
        return path
    base = F.regexp_replace(base, "/+$", "")
    inside = path.startswith(F.concat(base, F.lit("/")))
    return F.when(inside, F.concat(F.substring_index(base, "/", -1), F.substring(path, F.length(base) + 1, F.length(path)))).otherwise(path)


def _tar(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for path, content in zip(rows["path"], rows["content"]):
            info = tarfile.TarInfo(path)
            if path.endswith("/"):
                info.type, info.mode = tarfile.DIRTYPE, 0o755
                tar.addfile(info)
            else:
                info.size, info.mode = len(content or b""), 0o644
                tar.addfile(info, io.BytesIO(content or b""))
    return out.getvalue()


def _zip(level: int):
    def build(rows: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level if 0 <= level <= 9 else 6) as z:
            for path, content in zip(rows["path"], rows["content"]):
                info = zipfile.ZipInfo(path, _EPOCH)
                info.compress_type = zipfile.ZIP_DEFLATED
                info.external_attr = (0o755 | stat.S_IFDIR if path.endswith("/") else 0o644 | stat.S_IFREG) << 16
                z.writestr(info, content or b"")
        return out.getvalue()

    return build


def build(entries: DataFrame, key: str, name: str = "tar.zst", level: int = -1, volumes: int | None = None, order: str | None = None) -> DataFrame:
    """key, path, content -> key, volume, archive, error: an archive of each key (and volume) in the format `name`, like tar.gz or zip.

    Without `volumes` their number follows from the bytes of each key, so that what a task holds doesn't grow with the key; one entry is
    never split. A given number is taken as it is.

    Entries stand in path order and carry no times, so equal entries give equal bytes. A path that ends in / is a folder. Of
    equal paths the last by the column `order` stays (an ordinal of sources, a time), without one that of the largest content hash; contents are shuffled once
    for the fold, and twice only where `order` is given. Only these columns are read; names that are no archive raise ValueError.
    """
    return _build(entries, key, name, level, volumes, order)


def _build(entries: DataFrame, key: str, name: str, level: int, volumes: int | None = None, order: str | None = None, sized: DataFrame | None = None) -> DataFrame:
    """sized: key, path, size of the same entries, where volumes are better counted without their contents."""
    spark = entries.sparkSession
    blob_batches(spark)
    # a one-row projection of constants: the format algebra is written as column expressions
    p = spark.range(1).select(formats.pipeline_of_name(F.lit(name)).alias("p")).select("p.*", formats.is_valid(F.col("p")).alias("valid")).first()
    if not p.valid or p.archive not in ("tar", "zip"):
        raise ValueError(f"no archive format: {name}")
    make, type_ = (_zip(level) if p.archive == "zip" else _tar), entries.schema[key].dataType.simpleString()
    encode = None if p.codec == formats.UNKNOWN else standalone.ENCODERS[p.codec]

    def fold(group, rows):
        rows = rows.assign(rank=[hashlib.sha256(x or b"").digest() for x in rows["content"]]).sort_values(["path", "rank"], kind="stable").drop_duplicates("path", keep="last")
        made, error = make(rows), None
        if encode is not None:  # here and not in a UDF of its own, so that a task has one worker with one copy of the archive
            made, error = codecs.attempt(lambda: encode(made, level))
        return pd.DataFrame([(*group, made, error)], columns=["key", "volume", "archive", "error"])

    if order is not None:
        entries = last_written(entries, [key], F.col(order))
    rows = entries.select(F.col(key).alias("key"), "path", F.col("content").cast("binary").alias("content"))
    if volumes is None:
        many = volumes_of(rows if sized is None else sized).withColumnRenamed("key", "__key")
        rows = rows.join(F.broadcast(many), rows["key"].eqNullSafe(many["__key"]), "left").withColumn("volume", volume_of(F.col("path"), F.coalesce("volumes", F.lit(1)))).drop("__key", "volumes")
    else:
        rows = rows.withColumn("volume", volume_of(F.col("path"), volumes))
    return rows.groupBy("key", "volume").applyInPandas(fold, f"key {type_}, volume int, archive binary, error string").withColumnRenamed("key", key)


def _moment(make: Callable[[], pd.Timestamp]) -> pd.Timestamp | None:
    """Archives hold times that are none, like month 0, or that no timestamp reaches: those are null."""
    try:
        return make()
    except (ValueError, OverflowError):
        return None


def _tar_entries(raw: bytes, payload: bool, most: int = codecs.MAX_DECODED, wanted: set[str] | None = None) -> Iterator[tuple]:
    """wanted: only these paths are read. A hard link has the content of its target, if that comes before it."""
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as tar:
        for k, m in enumerate(tar):
            if wanted is not None and m.name not in wanted:
                continue
            kind = "dir" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "file" if m.isreg() else "special"
            content, size = None, m.size
            if m.islnk():
                try:
                    target = tar.extractfile(m)
                    size = target.seek(0, io.SEEK_END)
                    target.seek(0)
                    content = codecs.read_all(target, most) if payload else None
                except KeyError:
                    kind = "special"  # a link to nothing
            elif payload and m.isreg():
                content = codecs.read_all(tar.extractfile(m), most)
            yield k, m.name, kind, size, _moment(lambda: pd.Timestamp(m.mtime, unit="s")), m.mode, m.linkname if m.issym() or m.islnk() else None, content  # noqa: B023


def _zip_entries(raw: bytes, payload: bool, most: int = codecs.MAX_DECODED, wanted: set[str] | None = None) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for k, m in enumerate(z.infolist()):
            if wanted is not None and m.filename not in wanted:
                continue
            folder, content = m.filename.endswith("/"), None
            if payload and not folder:
                with z.open(m) as f:
                    content = codecs.read_all(f, most)
            yield k, m.filename, "dir" if folder else "file", m.file_size, _moment(lambda: pd.Timestamp(*m.date_time)), 0o755 if folder else 0o644, None, content  # noqa: B023


def entries(archives: DataFrame, keep: list[str], content: str = "archive", path: Column | None = None, payload: bool = True, most: int = codecs.MAX_DECODED) -> DataFrame:
    """The entries of each archive as rows: the columns `keep`, then ord, path, type, size, mtime, mode, link_target, content, error.

    An archive that can't be read gives one row with an error and no path. With payload=False contents stay packed and null.
    An archive or entry that decodes to more than `most` bytes is an error row.
    """
    return _entries(archives, keep, content, path, payload, most)


def _entries(archives: DataFrame, keep: list[str], content: str, path: Column | None, payload: bool, most: int, chosen: str | None = None) -> DataFrame:
    """chosen: a column of paths (array<string>); only these entries are read."""
    blob_batches(archives.sparkSession)
    raw = F.col(content)
    names = F.lit(None).cast("array<string>") if chosen is None else F.col(chosen)
    rows = archives.select(*keep, names.alias("__chosen"), raw.alias("__raw"), formats.pipeline_of_blob(raw, F.lit("x.tar.x") if path is None else path).alias("__p"))
    kind, codec = F.col("__p.archive"), F.when(F.col("__p.codec").isin(*STANDALONE), F.col("__p.codec"))
    # what is neither an archive nor packed is a row with an error: its bytes needn't be looked at
    rows = rows.select(*keep, "__chosen", F.when(kind.isin("tar", "zip") | codec.isNotNull(), F.col("__raw")).alias("__raw"), kind.alias("__archive"), codec.alias("__codec"))
    columns = [*keep, *(x.split()[0] for x in ENTRY.split(", ")), "error"]
    size = 4 << 20

    def frame_of(out):
        frame = pd.DataFrame(out, columns=columns)
        frame["mtime"] = pd.to_datetime(frame["mtime"])
        return frame

    def read_one(row) -> Iterator[tuple]:
        own, (names, raw, archive, codec) = tuple(row[: len(keep)]), row[len(keep) :]
        try:
            if raw is not None and codec is not None:
                raw, error = codecs.attempt(lambda: standalone.DECODERS[codec](raw, most))
                if error is not None:
                    raise ValueError(error)
            if raw is None or archive not in ("tar", "zip"):
                raise ValueError(f"not a readable archive: {archive}")
            for e in (_tar_entries if archive == "tar" else _zip_entries)(raw, payload, most, None if names is None else set(names)):
                yield (*own, *e, None)
        except Exception as e:  # noqa: BLE001 - a damaged archive is a row
            yield (*own, *[None] * 8, f"{type(e).__name__}: {e}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # a frame for many small archives, and several for a large one
            out, held = [], 0
            for row in batch.itertuples(index=False):
                for e in read_one(row):
                    out.append(e)
                    held += len(e[-2] or b"") + 200
                    if held > size:
                        yield frame_of(out)
                        out, held = [], 0
            if out:
                yield frame_of(out)

    kept = ", ".join(f"`{c}` {archives.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(read, f"{kept}, {ENTRY}, error string")


def extract(archives: DataFrame, keep: list[str], wanted: DataFrame | None = None, content: str = "archive", path: Column | None = None, **allow) -> DataFrame:
    """Entries that may be written, and refused ones with their reason in `error` and no content.

    wanted: a table with a column path; only entries of these names are taken. The archives are listed first, without contents, and the names are told
    to the reader of each archive, so unwanted contents are neither unpacked from a zip nor leave the reader. `keep` must then tell archives
    apart. Refused entries hold up none of the others.
    """
    if wanted is None:
        rows = entries(archives, keep, content, path)
    else:
        listed = entries(archives, keep, content, path, payload=False)
        names = listed.join(wanted.select("path").distinct(), "path", "left_semi").groupBy(*keep).agg(F.collect_set("path").alias("__names"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keep]
        chosen = archives.alias("a").join(names.alias("n"), same).select("a.*", "__names")
        rows = _entries(chosen, keep, content, path, True, codecs.MAX_DECODED, "__names")
    refused = policy.violation(F.col("path"), F.col("type"), **allow)
    rows = rows.withColumn("error", F.coalesce("error", refused)).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
    return rows


def missing(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Names that were asked for and are in no archive."""
    return wanted.select("path").distinct().join(listed.select("path"), "path", "left_anti")


def convert(archives: DataFrame, key: str, name: str, level: int = -1, content: str = "archive") -> DataFrame:
    """The same entries in another archive format, in volumes as build() makes them."""

    def kept(payload: bool) -> DataFrame:
        rows = entries(archives, [key], content, payload=payload).filter("error IS NULL AND type IN ('file', 'hardlink', 'dir')")
        return rows.withColumn("path", F.when((F.col("type") == "dir") & ~F.col("path").endswith("/"), F.concat("path", F.lit("/"))).otherwise(F.col("path")))

    # volumes follow from a listing, which unpacks no contents
    return _build(kept(True).select(key, "path", "content"), key, name, level, sized=kept(False).select(F.col(key).alias("key"), "path", "size"))
