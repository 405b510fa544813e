"""The session's shared folder, and results cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none, as in tests."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnfold-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
