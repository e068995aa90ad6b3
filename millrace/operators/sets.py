"""Set operations by position, read from left to right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

_KINDS = {
    "union_all": DataFrame.union, "union": lambda a, b: a.union(b).distinct(), "intersect": DataFrame.intersect,
    "intersect_all": DataFrame.intersectAll, "except": DataFrame.subtract,
    "except_all": DataFrame.exceptAll,
}


def chain(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """chain(a, ("union", b), ("except", c)) is (a UNION b) EXCEPT c, whatever SQL's precedence; names are the first's."""

    def step(a: DataFrame, s: tuple[str, DataFrame]) -> DataFrame:
        kind, b = s
        if len(a.columns) != len(b.columns):
            raise ValueError(f"{len(a.columns)} and {len(b.columns)} columns")
        return _KINDS[kind](a, b.toDF(*a.columns))

    return reduce(step, steps, first)
