"""The note grammar, the vault source and the streams."""

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import vault
from scriptorium.streaming import export as E

RAW = """---
title: "A: b"
type: [[Kind|x]]
aliases: [one, [[Two#h]]]
tags:
- true
- t2
# comment
status: Draft
status: final
---
See [[Ada#Life|her]], ![[pic.png]] and [[dir/Note.v2.md]].
<!-- [[hidden]] --> [[seen]]
````
[[code]]
```
[[still code]]
````
``` not ` a fence [[x]]
"""


def test_note_grammar():
    n = vault.note("a/b.md", RAW)
    assert n["title"] == "A: b" and n["type"] == "Kind" and n["status"] == "final" and n["aliases"] == ["one", "Two"]
    assert dict(n["frontmatter"])["tags"] == ["True", "t2"]
    assert [x["target"] for x in n["outlinks"]] == ["Ada", "dir/Note.v2.md", "seen", "x"] and [x["target"] for x in n["embeds"]] == ["pic.png"]
    assert "See her, pic and Note.v2." in n["text"] and "[[still code]]" in n["text"]
    assert vault.note("x/y.md", "no block")["title"] == "y"
    assert vault.front_matter("---\n---\nx")[0] == {}
    assert vault.scalar("TRUE") is True and vault.scalar("'[[a]]'") == "[[a]]" and vault.scalar("[]") == [] and vault.scalar("2026") == "2026"


def test_note_ids():
    assert vault.with_note_id("---\ntitle: x\n---\nb", "note_1") == "---\nid: note_1\ntitle: x\n---\nb"
    made = vault.with_note_id("b", "note_1")
    assert made == "---\nid: note_1\n---\nb" and vault.with_note_id(made, "note_2") == made


def test_scan_and_parse(spark, tmp_path):
    for name, text in {"a/One.md": "﻿# x\r\ny", "a/skip/Two.md": "z", "b/pic.png": "p", "a/Thumbs.db": "j", "Top.md": RAW}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    found = vault.scan(spark, str(tmp_path), exclude=("a/skip",))
    assert {r.path for r in found.collect()} == {"a/One.md", "Top.md"}
    everything = vault.scan(spark, str(tmp_path), include=("a", "b"), non_markdown=True).collect()
    assert {r.path: r.kind for r in everything} == {"a/One.md": "markdown", "a/skip/Two.md": "markdown", "b/pic.png": "file"}
    notes = vault.parse_notes(found.select("path", vault.decode(F.col("content")).alias("text")))
    assert {r.path: r.title for r in notes.collect()} == {"a/One.md": "One", "Top.md": "A: b"}
    assert notes.where("path = 'a/One.md'").first().body == "# x\ny"


def events(spark, rows):
    made = spark.createDataFrame(rows, "event_id string, session_key string, target string, operation string, at int")
    return made.select(
        "event_id", "session_key", "target", "operation", F.timestamp_seconds("at").alias("timestamp"), F.lit("task").alias("component"), F.lit("ok").alias("status"),
        F.lit(2.0).alias("duration_ms"), F.create_map(F.lit("action"), F.lit("go"), F.lit("secret"), F.lit("s")).alias("attributes"),
    )


def test_export_repeats_a_failed_batch(spark, tmp_path):
    log, mark, got = str(tmp_path / "log"), str(tmp_path / "mark"), []
    E.append(events(spark, [("1", "s", "p", "go", 1), ("2", "s", "p", "go", 2)]), log)

    def broken(batch, number):
        raise RuntimeError("sink is away")

    with pytest.raises(Exception):
        E.export(spark, log, mark, broken).awaitTermination()
    send = lambda batch, number: got.extend(batch.collect())
    E.export(spark, log, mark, send).awaitTermination()
    assert sorted(r.event_id for r in got) == ["1", "2"] and all(r.attributes == {"action": "go"} for r in got) and "target" not in got[0].asDict()
    E.append(events(spark, [("3", "s", "p", "go", 3)]), log)
    E.export(spark, log, mark, send).awaitTermination()
    assert sorted(r.event_id for r in got) == ["1", "2", "3"]
    first, pending = E.preview(spark, log, spark.createDataFrame([], "file string, acked long"), 2)
    assert pending == 3 and [r.event_id for r in first] == ["1", "2"]


def test_session_state(spark, tmp_path):
    log, got = str(tmp_path / "log"), []
    for rows in ([("1", "s", "a", "go", 1), ("2", "s", "a", "go", 2)], [("3", "s", "b", "go", 3), ("4", "t", None, "go", 4)], [("5", "s", "b", "task.finish", 5), ("6", "s", "b", "go", 6), ("7", "t", None, "go", 7)]):
        E.append(events(spark, rows), log)
        steps = E.session_steps(E.source(spark, log))
        query = steps.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r.event_id: r.step for r in got} == {"1": "start", "2": "reuse", "3": "supersede", "4": "start", "5": "finish", "6": "start", "7": "reuse"}


def test_sync(spark, tmp_path):
    feed, store = str(tmp_path / "feed"), str(tmp_path / "store")
    schema = "path string, sha256 string, deleted boolean, seq long"
    for rows in ([("a", "1", False, 1), ("b", "2", False, 2)], [("a", "9", False, 3), ("b", "", True, 4), ("c", "3", False, 5)]):
        spark.createDataFrame(rows, schema).write.mode("append").json(feed)
        E.sync(spark.readStream.schema(schema).json(feed), store, str(tmp_path / "mark")).awaitTermination()
    assert {r.path: r.sha256 for r in E.current(spark, store).collect()} == {"a": "9", "c": "3"}


def test_export_keeps_cursors(spark, tmp_path):
    log, store, got = str(tmp_path / "log"), str(tmp_path / "cursors"), []
    E.append(events(spark, [(str(i), "s", "p", "go", i) for i in range(7)]).coalesce(1), log)

    def broken(batch, number):
        got.append((number, [r.event_id for r in batch.collect()]))
        raise RuntimeError("sink is away")

    send = lambda batch, number: got.append((number, [r.event_id for r in batch.collect()]))
    with pytest.raises(RuntimeError):
        E.export_pending(spark, log, store, broken, max_events=3)
    assert E.cursors(spark, store).count() == 0
    assert E.export_pending(spark, log, store, send, max_events=3) == 3 and got[0] == got[1]  # the batch that failed, once more
    acked = {r.file: r.acked for r in E.cursors(spark, store).collect()}
    assert list(acked.values()) == [3]
    E.append(events(spark, [("late", "s", "p", "go", 0)]), log)  # older than all, in a file of its own
    assert {r.file: r.acked for r in E.cursors(spark, store).collect()} == acked
    assert [E.export_pending(spark, log, store, send, max_events=3) for _ in range(3)] == [3, 2, 0]
    sent = [e for _, batch in got[1:] for e in batch]
    assert sorted(sent) == sorted([*map(str, range(7)), "late"]) and max(len(b) for _, b in got) == 3
    with pytest.raises(ValueError):
        E.export_pending(spark, log, store, send, max_events=0)


def test_nested_values_never_leave(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = [
        '{"event_id": "1", "attributes": {"action": "[1]", "variant": ["s"], "workflow": {"a": 1}, "secret": 2, "result_count": 3, "low_quality": true, "task_kind": null}}',
        '{"event_id": "2", "attributes": {"action": {"a": 1, "a": "secret"}, "result_count": 3}}', '{"event_id": "3", "attributes": "action"}', '{"event_id": "4"}',
    ]
    (log / "a.json").write_text("\n".join(lines))
    rows = {r.event_id: r.attributes for r in E.traces.sanitize(E.log_lines(spark, str(log))).collect()}
    assert rows == {"1": {"action": "[1]", "result_count": "3", "low_quality": "true", "task_kind": None}, "2": {}, "3": {}, "4": {}}
    texts = spark.createDataFrame([({"action": '{"a":1,"a":"secret"}', "variant": ' [1]', "case_id": "{x"},)], "attributes map<string,string>")
    assert texts.select(E.traces.redact(F.col("attributes"))).first()[0] == {"case_id": "{x"}
