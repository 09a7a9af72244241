"""Sessions: build one for local use, or make a given one able to run this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Rows and bytes of texts that a Python worker gets at once; Spark's own defaults are for narrow rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers started by ``spark`` import this package.

    Workers get the driver's import path for it; where the package is installed or
    shipped with ``--py-files`` this changes nothing.  Batches for the workers are made
    smaller where the session leaves them at Spark's defaults.
    """
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, _ROOT) if x)
    return spark


def local(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scriptorium")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return attach(spark)
