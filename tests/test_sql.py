from granary import sql
from granary.operators import archive


def test_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT unpack_blob(p.data, 'zlib') AS r, pack_blob(CAST('x' AS BINARY), 'nope', 1) AS bad FROM (SELECT pack_blob(CAST('some text' AS BINARY), 'zlib', 6) AS p)").first()
    assert bytes(row.r.data) == b"some text" and row.bad.error == "no backend for nope"
    row = spark.sql("SELECT unpack_file(pack_file(CAST('some text' AS BINARY), 'xz', -1).data, 'xz') AS r").first()
    assert bytes(row.r.data) == b"some text"


def test_entries(spark):
    sql.register(spark)
    rows = spark.createDataFrame([("k", "a.txt", bytearray(b"one")), ("k", "b.txt", bytearray(b"three"))], "k string, path string, content binary")
    archive.build(rows, "k", "zip").createOrReplaceTempView("blobs")
    got = spark.sql("SELECT k, e.path, e.size, CAST(e.content AS STRING) AS text FROM blobs, LATERAL archive_entries(archive, 'zip', true) AS e ORDER BY e.path").collect()
    assert [tuple(r) for r in got] == [("k", "a.txt", 3, "one"), ("k", "b.txt", 5, "three")]
