"""Trace events as streams: append, export at least once, session state, incremental sync.

Logs are directories of immutable JSON files, one for each appended batch: a file source never
sees lines added to a file it has read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import traces
from ..storage import Buckets, exists, written

EVENT = (
    "event_id string, trace_id string, run_id string, span_id string, parent_span_id string, timestamp timestamp, agent string, session_key string,"
    " component string, operation string, status string, duration_ms double, target string"
)


def append(events: DataFrame, log: str) -> None:
    """Adds events to the log as new files, by day."""
    events.withColumn("event_date", F.to_date("timestamp")).write.mode("append").partitionBy("event_date").json(log)


def _events(lines: DataFrame, *more: str) -> DataFrame:
    """Events of the log's lines; attributes keep their JSON types as a variant, and those that can't be parsed are null."""
    attributes = F.try_parse_json(F.get_json_object("value", "$.attributes"))
    return lines.select(F.from_json("value", EVENT).alias("e"), attributes.alias("attributes"), *more).select("e.*", "attributes", *(m.split(".")[-1] for m in more))


def source(spark: SparkSession, log: str, files_per_batch: int = 20) -> DataFrame:
    return _events(spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").text(log))


def export(spark: SparkSession, log: str, checkpoint: str, send: Callable[[DataFrame, int], None], local_context: bool = False, files_per_batch: int = 20) -> StreamingQuery:
    """Sends sanitized events batch by batch until the log is drained.

    A batch is acknowledged after ``send`` returns; if it fails, the next run sends the same
    batch again.  ``send`` gets the batch's id, by which a sink can drop repeats.
    """
    clean = traces.spans(traces.sanitize(source(spark, log, files_per_batch), local_context))
    return clean.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_lines(spark: SparkSession, log: str) -> DataFrame:
    """Events with the file and the line, from 1, where they lie.

    A line's number is its place in the file, so an event that comes late moves no line that was acknowledged.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(log)
    place = read.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    rows = _events(place, "file_path", "file_block_start", "place").withColumnRenamed("file_path", "file")
    return rows.withColumn("line", F.row_number().over(W.partitionBy("file").orderBy("file_block_start", "place"))).drop("file_block_start", "place")


def preview(spark: SparkSession, log: str, cursors: DataFrame, limit: int = 5) -> tuple[list, int]:
    """(first events, how many are pending) past the cursors, without moving them.

    ``cursors(file, acked)`` names files of the log and the lines acknowledged in each.
    """
    left = traces.sanitize(traces.pending(log_lines(spark, log), cursors))
    return left.orderBy("timestamp", "event_id").limit(limit).collect(), left.count()


_CURSORS = "file string, acked int"


def cursors(spark: SparkSession, store: str) -> DataFrame:
    """(file, acked): the lines acknowledged in each file; the last whole version counts."""
    number = _version(spark, store)
    return spark.createDataFrame([], _CURSORS) if number is None else spark.read.schema(_CURSORS).parquet(f"{store}/v={number}")


def _version(spark: SparkSession, store: str) -> int | None:
    if not exists(spark, f"{store}/pointer"):
        return None
    return spark.read.schema("version long").json(f"{store}/pointer").agg(F.max("version")).first()[0]


def export_pending(
    spark: SparkSession, log: str, store: str, send: Callable[[DataFrame, int], None], *, max_events: int = 20, local_context: bool = False
) -> int:
    """Sends at most ``max_events`` pending events, in order of file and line, and then moves the cursors past them.

    Returns how many were sent.  If ``send`` fails no cursor moves, and the next call sends the same events again.
    ``send`` gets the events and the number of the batch, which stays until it is acknowledged.
    """
    if max_events < 1:
        raise ValueError("max_events must be positive")
    known, number = cursors(spark, store), (_version(spark, store) or 0) + 1
    due = traces.pending(log_lines(spark, log), known).orderBy("file", "line").limit(max_events)
    due = written(due, f"{store}/batch={number}")
    sent = due.count()
    if not sent:
        return 0
    send(traces.spans(traces.sanitize(due, local_context)), number)
    moved = known.union(due.select("file", F.col("line").alias("acked"))).groupBy("file").agg(F.max("acked").alias("acked"))
    moved.write.mode("overwrite").parquet(f"{store}/v={number}")
    spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").json(f"{store}/pointer")
    return sent


def session_steps(starts: DataFrame, key: str = "session_key", target: str = "target") -> DataFrame:
    """Streaming (session_key, event_id, step): start, reuse or supersede, by the target that the
    session had before.  A finished task (operation ``task.finish``) clears its session."""

    def run(session: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        known = state.exists
        rows = pd.concat(list(frames)).sort_values(["timestamp", "event_id"])
        out = []
        for event, wanted, operation in zip(rows["event_id"], rows["target"], rows["operation"]):
            wanted = None if pd.isna(wanted) else wanted
            if operation == "task.finish":
                known, step = False, "finish"
            else:
                step = "start" if not known else "reuse" if wanted == now else "supersede"
                now, known = wanted, True
            out.append((session[0], event, step))
        if known:
            state.update((now,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_key", "event_id", "step"])

    rows = starts.select(F.col(key).alias("session_key"), "event_id", "timestamp", F.col(target).alias("target"), "operation")
    return rows.groupBy("session_key").applyInPandasWithState(run, "session_key string, event_id string, step string", "target string", "append", "NoTimeout")


def sync(changes: DataFrame, store: str, checkpoint: str, key: str = "path", buckets: int = 64) -> StreamingQuery:
    """Applies a stream of (key, ..., deleted) to a bucketed Parquet store (``storage.Buckets``).

    A batch rewrites only the buckets that hold one of its keys.  Readers always see whole batches, and a repeated batch
    gives the same rows.  Of several rows of a key in a batch the one with the largest ``seq`` counts, if there is such a column.
    """
    fields = [c for c in changes.columns if c != "deleted"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema.fields if f.name != "deleted")

    def merge(batch: DataFrame, number: int) -> None:
        table = Buckets(batch.sparkSession, store, kinds, key, buckets)
        row = F.struct(*fields, "deleted")
        latest = batch.groupBy(key).agg((F.max_by(row, "seq") if "seq" in fields else F.first(row)).alias("r")).select("r.*")
        latest = written(latest, f"{store}/batch={number}")
        touched = {b for (b,) in latest.select(table.bucket()).distinct().collect()}
        stays = table.read(touched, below=number).join(latest.select(key), key, "left_anti").select(*fields)
        table.write(stays.unionByName(latest.where("not deleted").select(*fields)), touched, number, note=kinds)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows that the batches so far have left in the store; None before the first."""
    found = Buckets(spark, store, "key string", "key").manifest()
    return None if found is None else Buckets(spark, store, found[2], "key").read()
