"""Shared pieces of the training-data operators: tables, written intermediates, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space ones.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Where none is named, a local one serves a
    local master; on a cluster that is an error, as executors would write to folders of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Whether Spark deletes a query's shuffle files at its end. Else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows never recomputes it, whatever executor is lost.

    Its shuffle files go once it is written, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.rsplit("/", 1)[-1].startswith("t-"):
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes up to which a table may be broadcast; its rows are counted first. Arrays and strings count as WIDE bytes.
BROADCAST_BYTES, WIDE = 48 << 20, 96


def _width(df: DataFrame) -> int:
    return 16 + sum(8 if f.dataType.simpleString() in ("int", "bigint", "double", "boolean", "smallint", "tinyint", "float") else WIDE for f in df.schema)


def small_join(rows: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """rows joined with a table of narrow rows: broadcast if these have at most BROADCAST_BYTES, shuffled with rows otherwise."""
    fits = small.limit(BROADCAST_BYTES // _width(small) + 1).count() <= BROADCAST_BYTES // _width(small)
    return rows.join(F.broadcast(small) if fits else small, on, how)
