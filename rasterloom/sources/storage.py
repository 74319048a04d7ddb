"""Cutting lineage in iterative operators: a written checkpoint in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one that spark.checkpoint.dir names or, where it is unset and all runs on this machine (tests), a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="rasterloom-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the session's checkpoint folder; lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
