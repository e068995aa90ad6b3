"""Window expressions with the dialect's types and frames: counts are bigint, sums double, an ordered frame is by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(w: WindowSpec) -> WindowSpec:
    """From the partition's first row to this one; peers don't count."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ranked(f):
    return lambda w: f().over(w).cast("bigint")


row_number, rank, dense_rank = _ranked(F.row_number), _ranked(F.rank), _ranked(F.dense_rank)


def ntile(n: int, w: WindowSpec) -> Column:
    return F.ntile(n).over(w).cast("bigint")


def ntile_even(n: int, ordered: WindowSpec, partition: WindowSpec) -> Column:
    """Row i of m (from 0) is in bucket i * n / m, rounded down, plus 1."""
    return (F.floor((F.row_number().over(ordered) - 1) * n / F.count("*").over(partition)) + 1).cast("bigint")


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x.cast("double")).over(running(w))


def running_avg(x: Column, w: WindowSpec) -> Column:
    return F.avg(x.cast("double")).over(running(w))


def running_count(w: WindowSpec, x: Column | None = None) -> Column:
    return F.count(F.lit(1) if x is None else x).over(running(w))


def first_value(x: Column, w: WindowSpec) -> Column:
    return F.first(x).over(running(w))


def last_value(x: Column, w: WindowSpec) -> Column:
    """Of the frame that ends with this row."""
    return F.last(x).over(running(w))


def numbered(df: DataFrame, name: str = "row_number") -> DataFrame:
    """df with the numbers 1, 2, ... of its rows in their order, without gaps and without sorting or shuffling them.

    df is read twice: rows are counted by partition first, and each partition's are numbered on from the one before.
    """
    marked = df.withColumn(name, F.monotonically_increasing_id())
    part, place = F.shiftright(F.col(name), 33), F.col(name).bitwiseAND((1 << 33) - 1)
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("_part", before.alias("_before")))  # a row for each partition
    return marked.join(counts, part == F.col("_part")).select(*df.columns, (F.col("_before") + place + 1).alias(name))
