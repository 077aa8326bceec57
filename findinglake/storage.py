"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  A session on one machine that has none gets a folder of its own; a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; later jobs read it and don't repeat what made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
