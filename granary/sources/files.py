"""Files as rows, and rows as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from granary.operators.benchmark import SPEEDS


def blobs(spark: SparkSession, path: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """path, modificationTime, length and, if asked for, content of every file below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return rows if content else rows.drop("content")


def folders(files: DataFrame, root: str) -> DataFrame:
    """The folders below root that hold files, from the files' paths."""
    inner = F.substr(F.col("path"), F.instr("path", root) + F.lit(len(root.rstrip("/"))))
    parts = F.split(F.regexp_replace(inner, "^/+", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.select(F.explode(F.when(F.size(parts) > 1, prefixes)).alias("folder")).distinct()


def speeds(spark: SparkSession, path: str) -> DataFrame:
    """Measured speeds; rows with unreadable numbers are left out. A missing path gives an empty table.

    Both shapes are read: JSON lines with a column algo, and one object with a member per algorithm, the numbers inside.
    """
    from pyspark.errors import AnalysisException

    numbers = "STRUCT<comp_mb_s: STRING, decomp_mb_s: STRING, samples: STRING>"

    try:
        text = spark.read.text(path, wholetext=True)  # a row for each codec: such files are small
        one = F.from_json("value", f"MAP<STRING, {numbers}>", {"mode": "PERMISSIVE"})
        lines = spark.read.schema("algo string, comp_mb_s string, decomp_mb_s string, samples string").json(path).filter("algo IS NOT NULL")
        rows = lines.unionByName(text.select(F.explode(one).alias("algo", "n")).filter("n IS NOT NULL").select("algo", "n.*"))
    except AnalysisException:
        return spark.createDataFrame([], SPEEDS)
    numbers = rows.selectExpr("algo", "try_cast(comp_mb_s AS double) AS comp_mb_s", "try_cast(decomp_mb_s AS double) AS decomp_mb_s", "try_cast(samples AS long) AS samples")
    return numbers.dropna()


def save_speeds(table: DataFrame, path: str) -> None:
    table.select("algo", "comp_mb_s", "decomp_mb_s", "samples").write.mode("overwrite").json(path)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PrefixSource(DataSource):
    """path, length and the first `bytes` bytes of files: spark.read.format("prefix").option("bytes", 512).load(folder).

    binaryFile reads files whole; telling a format takes 512 bytes and a header 16. Paths are those that pyarrow can open.
    """

    @classmethod
    def name(cls) -> str:
        return "prefix"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema):
        return _PrefixReader(self.options)


class _PrefixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes, self.files = options["path"], int(options.get("bytes", "512")), int(options.get("filesPerTask", "256"))

    def partitions(self):
        from pyarrow import fs

        store, path = _filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        paths = sorted(f.path for f in found if f.is_file)
        return [_Part(paths[k : k + self.files]) for k in range(0, len(paths), self.files)] or [_Part([])]

    def read(self, partition):
        store, _ = _filesystem(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                yield path, f.size(), f.read(self.bytes)


class FileSink(DataSource):
    """One file per row (path, content) below a folder: df.write.format("files").mode("append").option("overwrite", "true").save(folder).

    Each file is written under a temporary name and renamed when the job commits; an aborted job leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs


class _FileWriter(DataSourceWriter):
    def __init__(self, options):
        self.root, self.overwrite = options["path"].rstrip("/"), options.get("overwrite", "false") == "true"

    def write(self, rows):
        import uuid

        store, root = _filesystem(self.root)
        pairs = []
        for row in rows:
            if row.path.startswith("/") or ".." in row.path.split("/"):
                raise ValueError(f"path leaves the folder: {row.path}")
            to = f"{root}/{row.path}"
            if not self.overwrite and store.get_file_info(to).is_file:
                raise FileExistsError(to)
            store.create_dir(to.rpartition("/")[0], recursive=True)
            with store.open_output_stream(tmp := f"{to}.{uuid.uuid4().hex}") as f:
                f.write(row.content or b"")
            pairs.append((tmp, to))
        return _Written(pairs)

    def commit(self, messages):
        store, _ = _filesystem(self.root)
        for tmp, to in (p for m in messages if m for p in m.pairs):
            store.move(tmp, to)

    def abort(self, messages):
        store, _ = _filesystem(self.root)
        for tmp, _to in (p for m in messages if m for p in m.pairs):
            store.delete_file(tmp)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PrefixSource)
    spark.dataSource.register(FileSink)
