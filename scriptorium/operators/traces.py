"""Trace events: redaction, spans, sessions, cursors (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

# The attributes that may leave the machine.
SAFE_ATTRIBUTES = (
    "action", "case_id", "catalog_valid", "entrypoint_count", "entrypoint_chars", "error_type",
    "low_quality", "omitted_entrypoint_count", "payload_chars", "rag_ready", "required_check_count",
    "result_count", "start_mode", "task_kind", "top_distance", "token_estimate", "variant", "workflow",
)


# The fields of an exported event, and those that are "unknown" where absent.
EVENT_FIELDS = ("timestamp", "trace_id", "run_id", "span_id", "parent_span_id", "agent", "session_key", "component", "operation", "status", "duration_ms")
NAMED_FIELDS = ("agent", "component", "operation", "status")


def redact(attributes: Column, typed: bool = False) -> Column:
    """The allowed attributes that are scalars, as a map of texts.

    ``typed``: a variant, whose values are judged by their stored type, so that a text which looks like
    an array stays and any nested value goes.  Else a map of texts, in which nested values have arrived as JSON: what reads as
    an array or object goes, objects that repeat a key included.
    """
    if not typed:
        return F.map_filter(attributes, lambda k, v: k.isin(*SAFE_ATTRIBUTES) & ~F.coalesce(v.rlike(r"^\s*[\[{]") & F.get_json_object(v, "$").isNotNull(), F.lit(False)))
    pairs = []
    for name in SAFE_ATTRIBUTES:
        value = F.try_variant_get(attributes, f"$.{name}", "variant")
        nested = F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)")
        pairs.append(F.when(value.isNotNull() & ~nested, F.struct(F.lit(name).alias("k"), value.try_cast("string").alias("v"))))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def sanitize(events: DataFrame, local_context: bool = False) -> DataFrame:
    """Events as they may leave the machine: a fixed list of fields, whatever others come in.

    They are named ``component.operation`` and keep their event_id, by which a sink drops repeats.
    Only allowed scalar attributes stay, and the target path only with ``local_context``.
    """
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    field = lambda c: F.coalesce(has(c), F.lit("unknown")) if c in NAMED_FIELDS else has(c)
    plain = F.expr("cast(map() as map<string, string>)")
    typed = "attributes" in events.columns and isinstance(events.schema["attributes"].dataType, VariantType)
    attributes = redact(F.col("attributes"), typed) if typed else redact(F.coalesce("attributes", plain)) if "attributes" in events.columns else plain
    return events.select(
        *(["event_id"] if "event_id" in events.columns else []),
        F.concat(field("component"), F.lit("."), field("operation")).alias("name"),
        *(field(c).alias(c) for c in EVENT_FIELDS),
        F.coalesce(attributes, plain).alias("attributes"),
        F.lit(False).alias("content_included"),
        *([has("target").alias("target")] if local_context else []),
    )


def spans(events: DataFrame) -> DataFrame:
    """Adds start_ns, end_ns (negative durations count as zero) and the span kind.

    Timestamps without a zone are taken as UTC, whatever the session's zone is.
    """
    zoned = events.schema["timestamp"].dataType.typeName() == "timestamp"
    start = (F.unix_micros("timestamp") if zoned else F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', timestamp)")) * 1000
    length = F.greatest(F.lit(0.0), F.coalesce("duration_ms", F.lit(0.0))) * 1_000_000
    kind = F.when(F.col("component") == "rag", "RETRIEVER").otherwise("TASK")
    return events.withColumns({"start_ns": start, "end_ns": start + length.cast("long"), "span_kind": kind})


def export_attributes(events: DataFrame, prefix: str) -> DataFrame:
    """Adds ``export``: all fields of a sanitized event as one map of prefixed attributes."""
    plain = ("trace_id", "run_id", "span_id", "agent", "session_key", "component", "status")
    fixed = F.create_map(*[x for c in plain for x in (F.lit(f"{prefix}.{c}"), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    own = F.transform_keys(F.map_filter("attributes", lambda _, v: v.isNotNull()), lambda k, _: F.concat(F.lit(prefix + "."), k))
    return events.withColumn("export", F.map_concat(fixed, own))


def session_steps(starts: DataFrame, key: str = "session_key", order: str = "event_id", target: str = "target_path") -> DataFrame:
    """Adds ``step``: start (first of its session), reuse (same target) or supersede."""
    before = F.lag(F.struct(F.col(target).alias("t"))).over(W.partitionBy(key).orderBy(order))
    step = F.when(before.isNull(), "start").when(before["t"].eqNullSafe(F.col(target)), "reuse").otherwise("supersede")
    return starts.withColumn("step", step)


def pending(events: DataFrame, cursors: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Events past their file's acknowledged line; files without a cursor are pending whole."""
    acked = cursors.select(file, F.col("acked"))
    return events.join(acked, file, "left").where(F.col(line) > F.coalesce("acked", F.lit(0))).drop("acked")
