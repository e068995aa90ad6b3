import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, sets
from millrace.plans.tables import Tables, spark_type
from millrace.sources import csv
from millrace.streaming import events as streams


def test_types():
    assert spark_type("Nullable(Int64)") == ("bigint", True)
    assert spark_type("Map(String, Array(UInt8))") == ("map<string,array<smallint>>", False)
    assert spark_type("Tuple(Int8, String)")[0] == "struct<_1:tinyint,_2:string>"
    assert spark_type("Tuple(a Int8, b Array(String))")[0] == "struct<a:tinyint,b:array<string>>"
    assert spark_type("Enum8('a' = 1)")[0] == "string" and spark_type("Decimal256(4)")[0] == "decimal(38,4)"
    with pytest.raises(ValueError):
        spark_type("Nothing(1)")


def test_table_changes(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.create("T", {"id": "Int64", "tags": "Array(String)", "v": "Nullable(Int64)", "s": "String"})
    with pytest.raises(ValueError):
        t.create("t", {"id": "Int64"})
    t.insert("t", [(1, ["a", "b"], 5, None), (2, None, None, "x")])
    t.insert("t", [(3,)], ["id"])
    rows = {r.id: (r.tags, r.v, r.s) for r in t.table("t").collect()}
    assert rows == {1: (["a", "b"], 5, ""), 2: ([], None, "x"), 3: ([], None, "")}
    assert t.update("t", {"id": F.col("v"), "v": F.col("id")}, F.col("v") > 0) == 1  # both see the old row
    assert sorted((r.id, r.v) for r in t.table("t").collect()) == [(2, None), (3, None), (5, 1)]
    assert t.delete("t", F.col("v") == 1) == 1 and t.table("t").count() == 2  # null keeps a row
    with pytest.raises(ValueError):
        t.insert("t", [("1",)], ["nothing"])
    t.drop("t")
    t.drop("t", if_exists=True)
    assert not t.exists("t") and t.names() == [] and not list(tmp_path.iterdir())
    t.create("t", {"id": "Int64", "n": "Nullable(Int32) DEFAULT 6 * 7"})
    t.insert("t", [(1,), (2,)], ["id"])
    before = len(list(tmp_path.glob("t-*/*")))
    t.insert("t", [(3, None)])
    assert len(list(tmp_path.glob("t-*/*"))) == before + 1 and sorted(map(tuple, t.table("t").collect())) == [(1, 42), (2, 42), (3, None)]


def test_csv_inference(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c,d,e\n1,0.5,true,2024-01-02 03:04:05,"x, ""y"""\n2,,false,2024-01-02 03:04:05,z\n\n3,7,0,bad\n')
    df = csv.read_csv(spark, str(tmp_path / "x.csv"))
    assert [k for _, k in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert [r.e for r in df.orderBy("a").collect()] == ['x, "y"', "z", None]
    assert csv.infer(["0", "1"]) == ("boolean", False) and csv.infer(["", ""]) == ("boolean", True) and csv.infer(["1", "2.5"]) == ("double", False)
    plain = csv.read_csv(spark, str(tmp_path / "x.csv"), header=False, infer_types=False)
    assert plain.columns[0] == "column1"


def test_csv_text_and_wide_numbers(spark):
    text = 'a,b\n1234567890123456789,"x,y"\n-9223372036854775808,z\n'
    df = csv.read_csv_text(spark, text)
    assert df.dtypes[0] == ("a", "bigint") and {r.a for r in df.collect()} == {1234567890123456789, -(1 << 63)}
    assert csv.csv_text(df.orderBy(F.desc("a"))) == text and csv.infer(["9223372036854775808"]) == ("double", False)


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, None, 5), (4, "k", None)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 5, "c"), (None, 1, "n"), ("k", None, "z")], "k string, rt int, v string")
    assert {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "rt").collect()} == {1: "c", 2: None, 3: None, 4: None}
    assert [r.id for r in joins.asof_join(left, right, ["k"], "t", "rt", how="inner").collect()] == [1]


def test_set_arity(spark):
    with pytest.raises(ValueError):
        sets.chain(spark.range(1), ("union", spark.range(1).selectExpr("id", "id AS b")))


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "a", float(i)) for i in range(60)], "user_id int, ts string, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed(stream, "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, streams.windowed(rows, "10 minutes").collect()))
