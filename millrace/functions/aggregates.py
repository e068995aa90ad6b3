"""The aggregate functions. Sums and averages are double; nulls are skipped; a ...If form takes a condition last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(x: Column) -> Column:
    return x.cast("double")


def _where(x: Column, condition: Column) -> Column:
    return F.when(condition, x)


def count(x: Column | None = None) -> Column:
    """Of rows, or of values that aren't null."""
    return F.count(F.lit(1) if x is None else x)


def any_(x: Column) -> Column:
    """Some value; deterministic only if all are equal. any_least is the same on every run."""
    return F.any_value(x, ignoreNulls=True)


def arg_min(arg: Column, value: Column) -> Column:
    """The arg at the least value, of rows with both; of ties the least arg."""
    both = F.when(arg.isNotNull() & value.isNotNull(), F.struct(value.alias("v"), arg.alias("a")))
    return F.min(both)["a"]


def arg_max(arg: Column, value: Column) -> Column:
    """The arg at the largest value, of rows with both; of ties the largest arg."""
    both = F.when(arg.isNotNull() & value.isNotNull(), F.struct(value.alias("v"), arg.alias("a")))
    return F.max(both)["a"]


def if_form(aggregate: Callable[..., Column]) -> Callable[..., Column]:
    """The aggregate over the rows that meet a condition, given last."""
    return lambda *xs: aggregate(*[_where(x, xs[-1]) for x in xs[:-1]])


def count_distinct(*xs: Column) -> Column:
    """Exact; rows with a null in one of xs don't count."""
    return F.countDistinct(*xs)


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": count, "sum": lambda x: F.sum(_double(x)), "avg": lambda x: F.avg(_double(x)), "min": F.min, "max": F.max,
    "any": any_, "anyLeast": F.min, "anyLast": lambda x: F.last(x, ignorenulls=True), "groupArray": F.collect_list,
    "groupUniqArray": lambda x: F.sort_array(F.collect_set(x)), "uniq": count_distinct, "uniqExact": count_distinct,
    "count_distinct": count_distinct, "uniqApprox": F.approx_count_distinct, "argMin": arg_min, "argMax": arg_max,
    "sumIf": lambda x, c: F.coalesce(F.sum(_where(_double(x), c)), F.lit(0.0)), "countIf": F.count_if,
    "avgIf": lambda x, c: F.avg(_where(_double(x), c)), "minIf": if_form(F.min), "maxIf": if_form(F.max),
    "uniqIf": if_form(count_distinct), "groupArrayIf": if_form(F.collect_list),
}
