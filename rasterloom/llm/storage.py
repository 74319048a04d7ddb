"""Shared working storage: the folder that the cluster names in spark.checkpoint.dir.

All working tables of a session lie in one folder there, `rasterloom/<application id>`.
They are read lazily, so they stay until the session's results have been
written; `clear(spark)` deletes the folder, `drop` single tables that nothing
will read again.  A session that ends without it leaves a folder whose name
tells which application it belonged to.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is named, a temporary one if all runs on this machine (tests), else an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rasterloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rasterloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's folder."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI, `file:/...` as Spark writes it included; for use in tasks and on the driver."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all working tables of the session; results that were not written can't be read any more."""
    _delete(spark, _home(spark))


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._rl_path)


def materialise(df: DataFrame, name: str, files: str = "as is", schema: StructType | None = None, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back: lineage ends there.

    A lost executor costs a reread, not a recomputation, and several consumers
    share the one computation.  `files` keeps the number of files (each costs
    several calls to the file system) in line with the data: "few" for tables
    of bounded size, "fewer" for aggregates (a quarter of the shuffle's
    partitions; never above a join or a Python stage, whose split partitions
    it would merge again), else what Spark's own sizing gives.  `schema` is
    what to read it as, if not as it was; `by` a column to make folders by.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if files != "as is":
        df = df.coalesce(8 if files == "few" else max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    writer = df.write.option("compression", compression)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the written table replaces the shuffle files: don't keep both
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._rl_path = path
    return out
