"""Reading the project's tables, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is sent to every worker only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, an error on a cluster, and a folder of its own in local mode (tests)."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
        folder = os.path.join(tempfile.gettempdir(), "maldure-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_ROWS, written: bool = False) -> DataFrame:
    """``df`` marked to be sent to every worker if it has few rows, by count; else it is joined as Spark sees fit. written: ``df`` is a checkpoint."""
    held = df if written else checkpoint(df)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer tasks than there are; for work that costs far more than a shuffle. ``df`` has no shuffle of its own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
