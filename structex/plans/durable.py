"""Results that must be computed once, such as paid replies, in files that every executor reads."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir.

    Where it is unset, a session whose executors are this process makes a folder of its own; on a
    cluster, where executors elsewhere couldn't read that, it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="structex-checkpoint-")
    sc.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: later branches and retries read what was written."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
