"""CSV with the dialect's inference: types from the first rows, cells that don't parse take the type's default."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable
from datetime import datetime

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_ROWS = 100
#: What a cell that is missing or doesn't parse becomes where its column holds no empty cells.
DEFAULTS = {"boolean": False, "bigint": 0, "double": 0.0, "timestamp": "1970-01-01 00:00:00", "string": ""}


def _is_time(x: str) -> bool:
    try:
        datetime.fromisoformat(x)
    except ValueError:
        return False
    return len(x) >= 8


_TESTS = (
    ("boolean", lambda x: x.lower() in ("true", "false", "0", "1")),
    ("bigint", lambda x: bool(re.fullmatch(r"[+-]?\d+", x)) and -(1 << 63) <= int(x) < 1 << 63),
    ("double", lambda x: bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x))),
    ("timestamp", _is_time),
)


def infer(values: Iterable[str | None]) -> tuple[str, bool]:
    """The first of boolean, bigint, double, timestamp and string that all cells are, and whether any is empty."""
    values = [v for v in values]
    filled = [v.strip() for v in values if v is not None and v.strip()]
    kind = next((k for k, ok in _TESTS if all(map(ok, filled))), "string")
    return kind, len(filled) < len(values)


def _cell(name: str, kind: str, nullable: bool) -> Column:
    x = F.col(f"`{name}`")
    if kind == "string":
        value = x
    elif kind == "boolean":
        value = F.when(F.lower(F.trim(x)).isin("true", "1"), True).when(F.lower(F.trim(x)).isin("false", "0"), False)
    else:
        value = F.trim(x).try_cast(kind)
    blank = x.isNull() | (F.trim(x) == "")
    default = F.lit(DEFAULTS[kind]).cast(kind)
    return F.when(blank, F.lit(None).cast(kind) if nullable else default).otherwise(F.coalesce(value, default)).alias(name)


def read_csv(
    spark: SparkSession, path: str | RDD, delimiter: str = ",", quote: str = '"', header: bool = True, infer_types: bool = True
) -> DataFrame:
    """Without a header the columns are column1, column2, ...; blank lines are skipped, short rows filled up."""
    raw = spark.read.csv(path, sep=delimiter, quote=quote, escape=quote, header=header, inferSchema=False, mode="PERMISSIVE")
    raw = raw if header else raw.toDF(*[f"column{i}" for i in range(1, len(raw.columns) + 1)])
    if not infer_types:
        return raw.na.fill("")
    sample = raw.limit(SAMPLE_ROWS).collect()
    return raw.select(*[_cell(c, *infer(r[i] for r in sample)) for i, c in enumerate(raw.columns)])


def read_csv_text(spark: SparkSession, text: str, **options) -> DataFrame:
    """As read_csv, from the text of a CSV file."""
    return read_csv(spark, spark.sparkContext.parallelize(text.splitlines()), **options)


def csv_text(df: DataFrame, delimiter: str = ",", quote: str = '"', header: bool = True) -> str:
    """The rows as the text of one CSV file, put together row by row; for results that a string is to hold."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, quotechar=quote, lineterminator="\n")
    if header:
        writer.writerow(df.columns)
    plain = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    writer.writerows(["" if x is None else x for x in row] for row in plain.toLocalIterator())
    return out.getvalue()


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, mode: str = "error") -> None:
    """Null is written as an empty cell."""
    df.write.csv(path, sep=delimiter, quote=quote, escape=quote, header=header, nullValue="", emptyValue="", mode=mode)
