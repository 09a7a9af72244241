"""Projections of records and events as others may see them: whitelisted, in a fixed order, bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import identity_state
from .catalog_sync import identity_key

# The longest text, the most items of a list and the most fields of a map that leave the catalog.
MOST_CHARS, MOST_ITEMS, MOST_FIELDS = 512, 12, 24
_KEY_CHARS, _SPAN_CHARS = 16, 16


def bounded_text(text: Column) -> Column:
    """At most 512 code points; a longer text ends in three dots.  Null stays null."""
    return F.when(F.length(text) > MOST_CHARS, F.concat(F.substring(text, 1, MOST_CHARS - 3), F.lit("..."))).otherwise(text)


def bounded_list(items: Column, most: int = MOST_ITEMS) -> Column:
    """struct of the first items, each bounded, their total, and whether some are left out; null is an empty list."""
    listed = F.coalesce(items, F.array().cast("array<string>"))
    return F.struct(F.transform(F.slice(listed, 1, most), bounded_text).alias("items"), F.size(listed).alias("total"), (F.size(listed) > most).alias("truncated"))


def bounded_map(fields: Column, most: int = MOST_FIELDS) -> Column:
    """struct of the first fields by key without regard to case, their values bounded, their total, and whether some are left out."""
    keys = F.array_sort(F.transform(F.map_keys(F.coalesce(fields, F.expr("cast(map() as map<string, string>)"))), lambda k: F.struct(F.lower(k).alias("low"), k.alias("k"))))
    kept = F.transform(F.slice(keys, 1, most), lambda x: F.struct(x["k"].alias("k"), bounded_text(F.element_at(fields, x["k"])).alias("v")))
    return F.struct(F.map_from_entries(kept).alias("items"), F.size(keys).alias("total"), (F.size(keys) > most).alias("truncated"))


def public_records(records: DataFrame) -> DataFrame:
    """The thirteen fields of a catalog record that answers show, bounded; absent fields are empty.

    Lists and the metadata are structs of items, total and truncated.
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")
    lists = lambda c: bounded_list(F.col(c) if c in records.columns else F.lit(None).cast("array<string>"))
    metadata = F.col("metadata") if "metadata" in records.columns else F.lit(None).cast("map<string, string>")
    state = identity_state(has("id"), F.col("path"))
    texts = {c: bounded_text(has(c)) for c in ("title", "kind", "extension", "type", "status", "primary_collection")}
    return records.select(
        bounded_text(F.col("path")).alias("path"), bounded_text(has("id")).alias("id"), state.alias("identity_state"), bounded_text(identity_key(has("id"), F.col("path"))).alias("identity_key"),
        *(c.alias(n) for n, c in texts.items()), lists("aliases").alias("aliases"), lists("collections").alias("collections"), bounded_map(metadata).alias("metadata"),
    )


def source_group(metadata: Column, title: Column, kind: Column) -> Column:
    """struct (source_group, source_kind): a note's book, else its project, else its own title as a concept or a note."""
    field = lambda c: F.nullif(F.coalesce(F.try_element_at(metadata, F.lit(c)), F.lit("")), F.lit(""))
    group = F.coalesce(field("book"), field("project"), title)
    what = F.when(field("book").isNotNull(), "book").when(field("project").isNotNull(), "project").when(kind == "concept", "concept").otherwise("note")
    return F.struct(group.alias("source_group"), what.alias("source_kind"))


def session_key(session: Column) -> Column:
    """What a session is known by outside: the first 16 hexadecimal digits of its hash."""
    return F.substring(F.sha2(session, 256), 1, _KEY_CHARS)


def events(steps: DataFrame) -> DataFrame:
    """Events of ``steps (trace_id, run_id, root_span_id, agent, session, component, operation, status, duration_ms, parent_span_id, target)``.

    Every event gets an id and a span id of its own, its session's key, durations to three places, and the run's
    root span where no parent is named.  Ids are drawn anew when a plan runs again: write the events before they are used twice.
    """
    span = F.substring(F.sha2(F.uuid(), 256), 1, _SPAN_CHARS)
    return steps.select(
        F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("event_id"), "trace_id", "run_id", span.alias("span_id"), F.coalesce("parent_span_id", "root_span_id").alias("parent_span_id"),
        F.current_timestamp().alias("timestamp"), F.coalesce("agent", F.lit("unknown")).alias("agent"), session_key(F.col("session")).alias("session_key"), "component", "operation", "status",
        F.round("duration_ms", 3).alias("duration_ms"), "target",
    )
