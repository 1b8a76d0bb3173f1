import json

from granary import cli


def run(spark, capsys, *args):
    cli.main([str(a) for a in args])
    return capsys.readouterr().out


def test_pack_inspect_unpack(spark, tmp_path, capsys):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("hello " * 500)
    (tmp_path / "in/deep/b.txt").write_text("there " * 500)
    out = run(spark, capsys, "pack", tmp_path / "in", "-o", tmp_path / "packed", "-s", "fast", "-l", 1)
    assert "lz4" in out and (tmp_path / "packed/deep/b.txt.comp").read_bytes()[:4] == b"COMP"
    shown = run(spark, capsys, "inspect", tmp_path / "packed", "--json")
    rows = [json.loads(x.strip("|")) for x in shown.splitlines() if x.startswith("|{")]
    assert [r["orig_size"] for r in rows] == [3000, 3000] and rows[0]["level"] == 1
    run(spark, capsys, "unpack", tmp_path / "packed", "-o", tmp_path / "back")
    assert (tmp_path / "back/a.txt").read_text() == "hello " * 500


def test_archive_list_extract(spark, tmp_path, capsys):
    (tmp_path / "tree/deep").mkdir(parents=True)
    (tmp_path / "tree/top.txt").write_text("top level")
    (tmp_path / "tree/deep/leaf.txt").write_text("leaf content")
    run(spark, capsys, "archive", tmp_path / "tree", "-o", tmp_path / "out", "-f", "tar.gz")
    archive = tmp_path / "out/tree.tar.gz"
    assert "deep/leaf.txt" in run(spark, capsys, "extract", archive, "--list")
    run(spark, capsys, "extract", archive, "top.txt", "-o", tmp_path / "some")
    assert [p.name for p in (tmp_path / "some").rglob("*.txt")] == ["top.txt"]


def test_bench_feeds_speeds(spark, tmp_path, capsys):
    (tmp_path / "x.bin").write_bytes(b"abc" * 1000)
    out = run(spark, capsys, "bench", tmp_path / "x.bin", "--algos", "zlib,lz4", "--strategies", "fast", "--speeds", tmp_path / "speeds")
    assert "zlib" in out and "auto" in out
    run(spark, capsys, "bench", tmp_path / "x.bin", "--algos", "zlib", "--strategies", "fast", "--speeds", tmp_path / "speeds")
    found = [json.loads(x) for f in (tmp_path / "speeds").glob("*.json") for x in f.read_text().splitlines()]
    assert {r["algo"]: r["samples"] for r in found} == {"zlib": 2, "lz4": 1}
    assert "snappy" in run(spark, capsys, "codecs")
