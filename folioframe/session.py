"""Session helpers shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Used only when the session names no shared folder, as in tests.
LOCAL_CHECKPOINT_DIR = "/tmp/folioframe-checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir``, or a local one where it is unset."""
    set_dir = spark.sparkContext.getCheckpointDir()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        if not wanted and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(wanted or LOCAL_CHECKPOINT_DIR)
    return wanted or set_dir or LOCAL_CHECKPOINT_DIR


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there.

    A plain ``checkpoint()`` survives the loss of executors and stops the optimiser from
    evaluating a costly branch twice when its result is used by several consumers.
    """
    checkpoint_dir(df.sparkSession)
    written = df.checkpoint(eager=True)
    release(df.sparkSession)
    return written


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs whose plans are no longer referred to, as those of what was written.

    Spark removes them when the driver's collector finds the plans dead, which on a small heap may be after the query.
    """
    spark.sparkContext._jvm.System.gc()
