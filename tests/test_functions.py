import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import AGGREGATES as A
from millrace.functions import SCALARS as S
from millrace.functions import Registry

L = F.lit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cases():
    return [
        (S["log"](L(0.0)), -math.inf), (S["log10"](L(0.0)), -math.inf), (S["log"](L(None).cast("double")), None),
        (S["round"](L(2.5)), 3.0), (S["round"](L(-2.5)), -3.0), (S["toInt64"](L(2.5)), 2), (S["toInt64"](L(3.5)), 4),
        (S["divide"](L(1), L(0)), math.inf), (S["divide"](L(None).cast("int"), L(0)), None), (S["intDiv"](L(-7), L(2)), -3),
        (S["modulo"](L(-7), L(2)), -1), (S["greatest"](L(None).cast("int"), L(3)), 3), (S["greatest"](L(4)), 4),
        (S["trim"](L("\t x y\n")), "x y"), (S["substring"](L("hello"), L(-3), L(2)), "he"), (S["substring"](L("hello"), L(9)), ""),
        (S["substring"](L("hello"), L(2), L(-1)), ""), (S["concat"](L("a"), L(None).cast("string"), L(1)), "a1"),
        (S["splitByChar"](L("."), L("a.b..")), ["a", "b", "", ""]), (S["splitByString"](L(""), L("ab")), ["ab"]),
        (S["splitByString"](L("||"), L("a||b|c")), ["a", "b|c"]), (S["position"](L("hello"), L("l")), 3), (S["position"](L("a"), L("z")), 0),
        (S["arrayStringConcat"](F.array(L("a"), L(None), L("b")), ","), "a,,b"), (S["format"]("{0}-{1}-{0} 5%", L("a"), L(2)), "a-2-a 5%"),
        (S["format"]("{5}", L("a")), "{5}"), (S["empty"](L(None).cast("string")), True), (S["notEmpty"](L("x")), True),
        (S["toDayOfWeek"](L("2024-01-07").cast("date")), 7), (S["toQuarter"](L("2024-05-07").cast("date")), 2),
        (S["dateDiff"]("year", L("2023-12-31"), L("2024-01-01")), 1), (S["dateDiff"]("day", L("2024-01-02 12:00:00"), L("2024-01-01 13:00:00")), 0),
        (S["formatDateTime"](L("2024-02-03 04:05:06"), "%Y%m%d %H'%M %S%%"), "20240203 04'05 06%"),
        (S["toUInt8"](L(255)), 255), (S["toUInt64"](L("18446744073709551615"), text=True), 18446744073709551615),
        (S["multiIf"](L(None).cast("boolean"), L(1), L(True), L(2), L(3)), 2), (S["has"](F.array(L(1), L(None)), L(None)), True),
        (S["arrayElement"](F.array(L(1), L(2)), L(0)), None), (S["arrayPopBack"](F.array().cast("array<int>")), []),
        (S["arraySlice"](F.array(L(1), L(2), L(3)), L(-5), L(2)), [1, 2]), (S["arraySlice"](F.array(L(1), L(2), L(3)), L(0)), [1, 2, 3]),
        (S["arraySlice"](F.array(L(1), L(2), L(3)), L(2), L(-1)), []), (S["arraySort"](F.array(L(2), L(None), L(1))), [None, 1, 2]),
        (S["emptyArrayToSingle"](F.array().cast("array<int>"), L(0)), [0]), (S["range"](L(3)), [0, 1, 2]), (S["range"](L(5), L(1)), []),
        (S["range"](L(1), L(5), L(0)), []), (S["range"](L(5), L(1), L(-3)), [5, 2]), (S["map"](L("k"), L(1), L("k"), L(2), L("odd")), {"k": 2}),
        (S["concatOperator"](L(None).cast("string"), L("b")), "b"), (S["LTRIM".lower()](L("  x ")), "x "),
    ]


def test_scalar(spark):
    pairs = cases()
    row = spark.range(1).select(*[c.alias(f"x{i}") for i, (c, _) in enumerate(pairs)]).first()
    assert [row[i] for i in range(len(pairs))] == [want for _, want in pairs]


def test_range_errors(spark):
    with pytest.raises(Exception, match="not from 0 to 255"):
        one(spark, S["toUInt8"](F.lit(256)))
    assert math.isnan(one(spark, S["log"](F.lit(-1.0))))


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", None, True), ("b", 5, False)], "k string, v int, f boolean")
    row = df.agg(
        A["count"]().alias("n"), A["count"](F.col("v")).alias("v"), A["sumIf"](F.col("v"), F.lit(False)).alias("none"),
        A["avgIf"](F.col("v"), F.lit(False)).alias("null"), A["argMax"](F.col("k"), F.col("v")).alias("m"), A["uniq"](F.col("v")).alias("u"),
    ).first()
    assert tuple(row) == (3, 2, 0.0, None, "b", 2)


def test_registry():
    r = Registry()
    r.register("twice", lambda x: x * 2)
    r.register_alias("double_it", "TWICE")
    assert "Double_It" in r and r.is_aggregate("SUM") and not r.is_aggregate("twice")
    with pytest.raises(KeyError):
        r["nothing"]
    assert "twice" not in Registry()
