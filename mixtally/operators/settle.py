"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Only a session on one machine without that setting, as in tests, gets a temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that all executors share; its lineage ends there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, n: int, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has been counted and n, its rows or members of rows, are `most` at most."""
    return F.broadcast(df) if n <= most else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
