"""Session plumbing that the operators share: durable cuts of lineage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where the setting is absent, a session on one machine (tests) gets a temporary folder; any other raises.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    context = spark.sparkContext._jsc.sc()
    current = context.getCheckpointDir()
    if named:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not context.isLocal():
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="scriptorium-checkpoints-")
    spark.sparkContext.setCheckpointDir(local)
    return "file://" + local


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and
    a lost executor costs nothing that was computed before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Collects what finished rounds left in the driver, so that Spark's cleaner drops
    their shuffle files, broadcasts and checkpoints now and not at its next turn."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
