"""Where jobs put what executors and the driver must both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tremor-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a folder of our own only where that is unset and Spark is local."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
