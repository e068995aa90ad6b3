"""Functions by name, for Python and for spark.sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from .aggregates import AGGREGATES
from .scalar import SCALARS

_LOG = "CASE WHEN x = 0 THEN double('-Infinity') WHEN x < 0 THEN double('NaN') ELSE {f}(x) END"
#: SQL functions whose argument types are the same in every use: name, arguments, body. Catalyst puts the body in place.
SQL_FUNCTIONS = [
    ("intDiv", "a DOUBLE, b DOUBLE", "CAST(bround(a) AS BIGINT) DIV CAST(bround(b) AS BIGINT)"),
    ("modulo", "a DOUBLE, b DOUBLE", "CAST(bround(a) AS BIGINT) % CAST(bround(b) AS BIGINT)"),
    ("divideOrInf", "a DOUBLE, b DOUBLE", "CASE WHEN a IS NOT NULL AND b = 0 THEN double('Infinity') ELSE a / nullif(b, 0D) END"),
    ("logOrInf", "x DOUBLE", _LOG.format(f="ln")),
    ("toYear", "d TIMESTAMP", "CAST(year(d) AS BIGINT)"),
    ("toMonth", "d TIMESTAMP", "CAST(month(d) AS BIGINT)"),
    ("toDayOfMonth", "d TIMESTAMP", "CAST(dayofmonth(d) AS BIGINT)"),
    ("toHour", "d TIMESTAMP", "CAST(hour(d) AS BIGINT)"),
    ("toMinute", "d TIMESTAMP", "CAST(minute(d) AS BIGINT)"),
    ("toSecond", "d TIMESTAMP", "CAST(second(d) AS BIGINT)"),
    ("toDayOfWeek", "d TIMESTAMP", "CAST(weekday(d) + 1 AS BIGINT)"),
    ("toDayOfYear", "d TIMESTAMP", "CAST(dayofyear(d) AS BIGINT)"),
    ("toQuarter", "d TIMESTAMP", "CAST(quarter(d) AS BIGINT)"),
    ("toDate", "d TIMESTAMP", "CAST(d AS DATE)"),
    ("toDateTime", "s STRING", "CAST(s AS TIMESTAMP)"),
    ("toUnixTimestamp", "d TIMESTAMP", "unix_timestamp(d)"),
    ("fromUnixTimestamp", "n BIGINT", "timestamp_seconds(n)"),
    ("yesterday", "", "date_sub(current_date(), 1)"),
    ("today", "", "current_date()"),
    ("splitByChar", "sep STRING, s STRING", r"split(s, concat('\\Q', left(sep, 1), '\\E'), -1)"),
    ("splitByString", "sep STRING, s STRING", r"IF(sep = '', array(s), split(s, concat('\\Q', sep, '\\E'), -1))"),
    ("trimLeft", "s STRING", r"regexp_replace(s, '^[\\s\\p{Z}]+', '')"),
    ("trimRight", "s STRING", r"regexp_replace(s, '[\\s\\p{Z}]+$', '')"),
    ("toInt8", "x DOUBLE", "CAST(bround(x) AS TINYINT)"),
    ("toInt16", "x DOUBLE", "CAST(bround(x) AS SMALLINT)"),
    ("toInt32", "x DOUBLE", "CAST(bround(x) AS INT)"),
    ("toInt64", "x DOUBLE", "CAST(bround(x) AS BIGINT)"),
    ("toFloat32", "x DOUBLE", "CAST(x AS FLOAT)"),
    ("toFloat64", "x DOUBLE", "x"),
    ("generateUUIDv4", "", "uuid()"),
]


def register_sql(spark: SparkSession) -> None:
    """Make SQL_FUNCTIONS known to this session's spark.sql."""
    for name, arguments, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {body}")


class Registry:
    """Scalar and aggregate functions by name, whatever the case; a registry belongs to whoever makes it."""

    def __init__(self) -> None:
        self._scalars = {k.lower(): f for k, f in SCALARS.items()}
        self._aggregates = {k.lower(): f for k, f in AGGREGATES.items()}

    def register(self, name: str, function: Callable[..., Column], aggregate: bool = False) -> None:
        """function: from Columns to a Column; a pandas_udf is one too."""
        (self._aggregates if aggregate else self._scalars)[name.lower()] = function

    def register_alias(self, alias: str, name: str) -> None:
        self.register(alias, self[name], self.is_aggregate(name))

    def is_aggregate(self, name: str) -> bool:
        return name.lower() in self._aggregates

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._aggregates or name.lower() in self._scalars

    def __getitem__(self, name: str) -> Callable[..., Column]:
        key = name.lower()
        if key not in self:
            raise KeyError(f"no such function: {name}")
        return self._aggregates[key] if key in self._aggregates else self._scalars[key]
