"""Bounded projections, source groups, session keys and events."""

import hashlib

from pyspark.sql import functions as F

from scriptorium.operators import projections as P


def test_public_records(spark):
    rows = [
        ("a/n.md", "note_" + "0" * 32, "t" * 513, [f"a{i}" for i in range(13)], {f"k{i:02}": "v" * 600 for i in range(25)}), ("a/pic.png", None, None, None, None),
        ("b.md", "NOTE", "\U0001f600" * 512, [None, "x"], {"B": "1", "a": None}),
    ]
    frame = spark.createDataFrame(rows, "path string, id string, title string, aliases array<string>, metadata map<string,string>")
    one, two, three = P.public_records(frame).orderBy("path").collect()
    one, two, three = (one, two, three) if one.path == "a/n.md" else (two, one, three)
    assert one.title == "t" * 509 + "..." and (len(one.aliases["items"]), one.aliases["total"], one.aliases["truncated"]) == (12, 13, True)
    assert (len(one.metadata["items"]), one.metadata["total"], one.metadata["truncated"]) == (24, 25, True) and one.metadata["items"]["k00"].endswith("v...")
    assert (one.identity_state, one.identity_key) == ("stable", one.id) and two.identity_state == "not-applicable" and two.identity_key == "legacy-path:a/pic.png"
    assert two.title == "" and two.aliases["items"] == [] and two.metadata["total"] == 0 and two.collections["truncated"] is False
    assert len(three.title) == 512 and three.aliases["items"] == [None, "x"] and list(three.metadata["items"].items()) == [("a", None), ("B", "1")]
    assert P.public_records(frame.limit(0)).count() == 0


def test_source_group(spark):
    rows = [({"book": "B", "project": "P"}, "concept"), ({"project": "P", "book": ""}, "note"), ({}, "concept"), (None, None)]
    frame = spark.createDataFrame(rows, "m map<string,string>, type string")
    found = [tuple(r.g) for r in frame.select(P.source_group(F.col("m"), F.lit("T"), F.col("type")).alias("g")).collect()]
    assert found == [("B", "book"), ("P", "project"), ("T", "concept"), ("T", "note")]


def test_events(spark):
    names = "trace_id run_id root_span_id agent session component operation status duration_ms parent_span_id target".split()
    rows = [("t", "r", "root", None, "s", "rag", "go", "ok", 1.23456, None, None), ("t", "r", "root", "x", "s", "rag", "go", "ok", None, "p", "a.md")]
    found = P.events(spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 'duration_ms' else 'string'}" for n in names))).collect()
    assert [(r.agent, r.duration_ms, r.parent_span_id) for r in found] == [("unknown", 1.235, "root"), ("x", None, "p")]
    assert {r.session_key for r in found} == {hashlib.sha256(b"s").hexdigest()[:16]}
    assert len({r.event_id for r in found}) == 2 and all(len(r.event_id) == 32 and len(r.span_id) == 16 for r in found)
