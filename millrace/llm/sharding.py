"""Sharding by a permutation-filled lookup table.

Each shard orders the slots of a prime-sized table by its own permutation. The shards take turns, each claiming
the first slot of its order that is still free, until the table is full. A row's key hashes to a slot and the slot
names the shard, so every row is placed by one small broadcast lookup, no shard holds more than a slot or so above
its share, and adding or removing a shard moves few keys. The table's size is a parameter, never the data's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099
#: A table of more slots than this is refused: it is broadcast to every task.
MAX_SLOTS = 1_000_003


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def claim_slots(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claims it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and named once")
    if slots < len(shards) or slots > MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    orders = [(_digest(f"{s}/offset") % slots, _digest(f"{s}/skip") % (slots - 1) + 1) for s in shards]
    owner, tried = [-1] * slots, [0] * len(shards)
    for turn in range(slots):
        k = turn % len(shards)
        offset, skip = orders[k]
        while owner[slot := (offset + tried[k] * skip) % slots] >= 0:
            tried[k] += 1
        owner[slot] = k
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key has that of the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(slots)


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """slot long, shard string: one row for each slot."""
    owners = F.split(F.lit(",".join(map(str, claim_slots(shards, slots)))), ",")
    names = F.array(*map(F.lit, shards))
    return (
        spark.range(1)
        .select(F.posexplode(owners).alias("slot", "owner"))
        .select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))
    )


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` long and ``shard`` string to each row, without a shuffle.

    Rows with equal keys go to one shard; null keys go where the empty string does; empty tables stay empty.
    Columns of ``df`` named slot or shard are replaced.
    """
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(df[key], slots))
    return rows.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot", "left").select(
        *[rows[c] for c in rows.columns], "shard"
    )


def moved(df: DataFrame, key: str, before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """One row: n_rows, n_moved: how many rows change their shard between two sets of shards."""
    spark = df.sparkSession
    both = lookup_table(spark, before, slots).join(
        lookup_table(spark, after, slots).withColumnRenamed("shard", "shard_after"), "slot"
    )
    return (
        df.select(slot_of(df[key], slots).alias("slot"))
        .join(F.broadcast(both), "slot")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("shard") != F.col("shard_after")).alias("n_moved"),
        )
    )
