"""Tables from nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(spark: SparkSession, count: int, start: int = 0) -> DataFrame:
    """number: start, start + 1, ... ; count rows."""
    return spark.range(start, start + count).toDF("number")


def zeros(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).select(F.lit(0).cast("bigint").alias("zero"))


def one(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("smallint").alias("dummy"))
