"""Joins beyond DataFrame.join's own kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def right_semi(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """The right rows with a match on the left."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """The right rows without a match on the left."""
    return right.join(left, on, "left_anti")


def any_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str | Column], how: str = "inner") -> DataFrame:
    """Each left row with one match at most: the first of its keys in ``order`` (of the right side's columns)."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return left.join(right.withColumn("_n", first).filter("_n = 1").drop("_n"), list(keys), how)


def using_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where null equals null; the keys come once, first."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    keyed = [F.coalesce(left[k], renamed[f"_r_{k}"]).alias(k) for k in keys]
    rest = [left[c] for c in left.columns if c not in keys] + [renamed[c] for c in right.columns if c not in keys]
    return left.join(renamed, on, how).select(*keyed, *rest)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, how: str = "left") -> DataFrame:
    """Each left row with the last right row of its keys at or before its time.

    Both sides are laid in one row of time and each left row takes the last right row before it: one shuffle on the keys
    and one sort, whatever the number of right rows for a key. Of right rows at one time the largest (as a struct of its
    columns) holds. Rows whose key or time is null have no match. Columns of right other than the keys must not clash.
    """
    payload = [c for c in right.columns if c not in keys]
    lefts, known = left.columns, F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*lefts).alias("_l"), F.lit(None).alias("_r"))
    b = right.filter(F.col(right_time).isNotNull() & known)
    b = b.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_l"), F.struct(*payload).alias("_r"))
    before = Window.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_r", ignorenulls=True).over(before)
    rows = a.unionByName(b).withColumn("_m", F.when(F.col("_t").isNotNull() & known, last)).filter("_side = 1")
    rows = rows if how == "left" else rows.filter(F.col("_m").isNotNull())
    return rows.select(*[F.col("_l")[c].alias(c) for c in lefts], *[F.col("_m")[c].alias(c) for c in payload])


def array_join_rows(df: DataFrame, array: str, alias: str, outer: bool = False) -> DataFrame:
    """A row for each element; rows of empty or null arrays go, or stay with null if outer."""
    return df.withColumn(alias, F.explode_outer(array) if outer else F.explode(array))
