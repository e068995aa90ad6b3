"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir; in a local folder only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named}/{name}-{uuid.uuid4().hex}"
