import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.operators import archive
from granary.sources import files
from granary.streaming import ingest


def rows(spark):
    return spark.createDataFrame([("k", "top.txt", bytearray(b"top level")), ("k", "deep/leaf.txt", bytearray(b"leaf content")), ("k", "deep/", None), ("j", "empty", bytearray(b""))], "k string, path string, content binary")


@pytest.mark.parametrize("name", ["tar", "zip", "tar.gz", "tgz", "tar.bz2", "tar.xz", "tar.zst", "tar.lz4"])
def test_build_and_read(spark, name):
    built = archive.build(rows(spark), "k", name)
    got = sorted((r.k, r.path.rstrip("/"), r.type, bytes(r.content or b""), r.error) for r in archive.entries(built, ["k"]).collect())
    assert got == [("j", "empty", "file", b"", None), ("k", "deep", "dir", b"", None), ("k", "deep/leaf.txt", "file", b"leaf content", None), ("k", "top.txt", "file", b"top level", None)]


def test_other_tools_read_archives_and_equal_entries_give_equal_bytes(spark):
    made = {r.k: bytes(r.archive) for r in archive.build(rows(spark), "k", "zip").collect()}
    assert made == {r.k: bytes(r.archive) for r in archive.build(rows(spark).repartition(3), "k", "zip").collect()}
    assert zipfile.ZipFile(io.BytesIO(made["k"])).read("deep/leaf.txt") == b"leaf content"
    tar = {r.k: bytes(r.archive) for r in archive.build(rows(spark), "k", "tar").collect()}
    assert tarfile.open(fileobj=io.BytesIO(tar["k"])).extractfile("top.txt").read() == b"top level"


@pytest.mark.parametrize("name", ["gzip", "zip.gz", "7z", "nonsense", "container"])
def test_no_archive_format(spark, name):
    with pytest.raises(ValueError):
        archive.build(rows(spark), "k", name)


def hostile():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, kind in (("ok.txt", None), ("../up.txt", None), ("/abs.txt", None), ("link", tarfile.SYMTYPE), ("pipe", tarfile.FIFOTYPE)):
            info = tarfile.TarInfo(name)
            if kind:
                info.type, info.linkname = kind, "ok.txt" if kind == tarfile.SYMTYPE else ""
                tar.addfile(info)
            else:
                info.size = 4
                tar.addfile(info, io.BytesIO(b"data"))
    return out.getvalue()


def test_policy_refuses_and_goes_on(spark):
    df = spark.createDataFrame([(1, bytearray(hostile())), (2, bytearray(b"PK\x03\x04 broken"))], "id int, archive binary")
    got = {(r.id, r.path): r.error for r in archive.extract(df, ["id"]).collect()}
    assert got[1, "ok.txt"] is None and got[1, "link"] == "symlink" and got[1, "pipe"] == "special file" and got[1, "../up.txt"] == "path traversal" and got[1, "/abs.txt"] == "absolute path"
    assert got[2, None].startswith("BadZipFile")
    linked = {r.path: r.error for r in archive.extract(df.filter("id = 1"), ["id"], allow_symlinks=True).collect()}
    assert linked["link"] is None


def test_stored_paths(spark):
    df = spark.createDataFrame([("/a/tree/deep/x", "/a/tree/"), ("/b/x", "/a/tree"), ("/a/trees/x", "/a/tree")], "p string, b string")
    assert [r[0] for r in df.select(archive.stored_path(F.col("p"), F.col("b"))).collect()] == ["tree/deep/x", "/b/x", "/a/trees/x"]


def test_files_in_and_out(spark, tmp_path):
    files.register(spark)
    out = str(tmp_path / "out")
    table = spark.createDataFrame([("a/b.txt", bytearray(b"one")), ("c.bin", bytearray(b"\x00\x01" * 400))], "path string, content binary")
    table.write.format("files").mode("append").save(out)
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"one" and len([p for p in (tmp_path / "out").rglob("*") if p.is_file()]) == 2
    with pytest.raises(Exception, match="FileExistsError|b.txt|c.bin"):
        table.write.format("files").mode("append").save(out)
    table.write.format("files").mode("append").option("overwrite", "true").save(out)
    head = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.content)) for r in spark.read.format("prefix").option("bytes", 4).load(out).collect()}
    assert head == {"b.txt": (3, b"one"), "c.bin": (800, b"\x00\x01\x00\x01")}
    found = files.blobs(spark, out, content=False)
    assert "content" not in found.columns and found.count() == 2
    assert [r.folder for r in files.folders(found, out).collect()] == ["a"]


def test_speeds_file(spark, tmp_path):
    path = str(tmp_path / "speeds")
    assert files.speeds(spark, path).count() == 0
    (tmp_path / "speeds").mkdir()
    (tmp_path / "speeds/x.json").write_text('{"algo": "zlib", "comp_mb_s": 1.5, "decomp_mb_s": 2, "samples": 3}\n{"algo": "lz4", "comp_mb_s": "fast", "decomp_mb_s": 2, "samples": 3}\n')
    table = files.speeds(spark, path)
    assert [tuple(r) for r in table.collect()] == [("zlib", 1.5, 2.0, 3)]
    files.save_speeds(table, str(tmp_path / "again"))
    assert files.speeds(spark, str(tmp_path / "again")).collect() == table.collect()


def test_stream_of_files(spark, tmp_path):
    from granary.functions import standalone

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.gz").write_bytes(standalone.ENCODERS["gzip"](b"first", 6))
    for k in (1, 2):
        ingest.drain(ingest.unpacked(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == k
        (folder / "b.zst").write_bytes(standalone.ENCODERS["zstd"](b"second", 3)[:-1])
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert bytes(rows["a.gz"].data) == b"first" and rows["b.zst"].error is not None


def test_links_and_times_of_real_archives(spark):
    import io
    import tarfile
    import zipfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, kind, target, time in (("a.txt", tarfile.REGTYPE, "", 10), ("hard", tarfile.LNKTYPE, "a.txt", 1 << 40), ("lost", tarfile.LNKTYPE, "nowhere", 0)):
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.mtime = kind, target, time
            info.size = 5 if kind == tarfile.REGTYPE else 0
            tar.addfile(info, io.BytesIO(b"hello"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name in ("one", "two"):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), name)
    dated = packed.getvalue().replace(b"\x00\x00\x21\x00", b"\x00\x00\x00\x00")  # day and month 0
    df = spark.createDataFrame([(1, out.getvalue()), (2, dated), (3, b"PK\x03\x04 cut")], "k int, archive binary")
    got = {(r.k, r.path): r for r in archive.extract(df, ["k"]).collect()}
    assert bytes(got[1, "hard"].content) == b"hello" and got[1, "hard"].type == "hardlink" and got[1, "hard"].link_target == "a.txt" and got[1, "hard"].mtime is None
    assert got[1, "lost"].error == "special file"
    assert bytes(got[2, "two"].content) == b"two" and got[2, "one"].mtime is None
    assert got[3, None].error
    wanted = spark.createDataFrame([("hard",), ("two",), ("nothing",)], "path string")
    assert sorted((r.k, r.path, bytes(r.content)) for r in archive.extract(df, ["k"], wanted).collect()) == [(1, "hard", b"hello"), (2, "two", b"two")]


def test_order_of_sources_decides_between_equal_paths(spark):
    df = spark.createDataFrame([(1, "x", b"second", 2), (1, "x", b"zfirst", 1), (1, "y", b"only", 1)], "k int, path string, content binary, ordinal int")
    rows = archive.entries(archive.build(df, "k", "tar", order="ordinal"), ["k"]).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == [("x", b"second"), ("y", b"only")]


def test_speeds_as_one_object(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"zlib": {"comp_mb_s": 10.5, "decomp_mb_s": 20, "samples": 3},\n "lz4": {"comp_mb_s": "bad", "decomp_mb_s": 1, "samples": 1}}')
    assert [tuple(r) for r in files.speeds(spark, str(tmp_path / "s.json")).collect()] == [("zlib", 10.5, 20.0, 3)]


def test_folders_of_a_root_with_a_quote(spark):
    rows = spark.createDataFrame([("/o'b/a/b/c.txt",)], "path string")
    assert sorted(r.folder for r in files.folders(rows, "/o'b").collect()) == ["a", "a/b"]
