"""Connected components of a link table, by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _flat(parents: DataFrame) -> DataFrame:
    """parents (node, component) with each node's last ancestor; a node's parent is itself or less."""
    while True:
        up = parents.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = parents.join(up, "component").select("node", F.col("above").alias("component"), (F.col("above") != F.col("component")).alias("moved"))
        jumped = stored(jumped)
        dropped(parents)
        parents = jumped.select("node", "component")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """node, component for each node of links (a, b; of one comparable type): the least node reachable.

    Each round every node takes its least neighbour, if that is less, as its parent, and then the last of its ancestors.
    Links are carried over to these, so that a link inside a group is looked at once and only those between groups go
    into the next round, until there are none. Links with a null end are ignored; loops and repeated links do no harm;
    no links give an empty table.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    between = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not rounds or not between.isEmpty():
        both = between.union(between.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        flat = _flat(stored(parents.select("node", F.least("node", "least").alias("component"))))
        rounds.append(flat)
        of = lambda c: flat.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        carried = between.join(of("a"), "a").join(of("b"), "b").filter("of_a <> of_b")
        carried = stored(carried.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct())
        dropped(between)
        between = carried
    dropped(between)
    placed = rounds.pop()
    while rounds:
        last = placed.select(F.col("node").alias("component"), F.col("component").alias("now"))
        placed = rounds.pop().join(last, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return stored(placed)
