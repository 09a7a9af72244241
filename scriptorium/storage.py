"""Folders that driver and executors share, and versioned stores in them."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder of this name in the folder that the cluster names in ``spark.checkpoint.dir``.

    Without that setting a local session (one machine) gets a temporary folder; any other raises.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """A table dealt into buckets by a hash of its key, of which a write replaces only those it names.

    ``data/v=/bucket=`` holds rows, ``manifest`` says which write holds each bucket.  The manifest is written last, so readers
    see whole writes only, and a failed one leaves the last in place.  A manifest is a row for each bucket, a number set here.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, below: int | None = None) -> tuple[int, dict[int, int], str] | None:
        """(number, write of each bucket, note) of the last write, or of the last one below a number."""
        if not exists(self.spark, f"{self.folder}/manifest"):
            return None
        rows = self.spark.read.schema("number long, parts string, note string").json(f"{self.folder}/manifest")
        rows = rows if below is None else rows.where(F.col("number") < below)
        last = rows.agg(F.max_by(F.struct("number", "parts", "note"), "number").alias("m")).first().m
        return None if last is None else (last.number, {int(b): v for b, v in json.loads(last.parts).items()}, last.note)

    def read(self, buckets: set[int] | None = None, below: int | None = None) -> DataFrame:
        """The rows of some buckets or all."""
        found = self.manifest(below)
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in (found[1] if found else {}).items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, touched: set[int], number: int, note: str = "") -> None:
        """``rows`` become the touched buckets' rows; the others keep their files."""
        where = f"{self.folder}/data/v={number}"
        made = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", self.bucket())
        made.repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(where)
        there = {b for (b,) in self.spark.read.schema("bucket int").parquet(where).distinct().collect()} if touched else set()
        before = self.manifest(number)
        parts = {b: v for b, v in (before[1] if before else {}).items() if b not in touched} | dict.fromkeys(there, number)
        row = self.spark.createDataFrame([(number, json.dumps(parts), note)], "number long, parts string, note string")
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
