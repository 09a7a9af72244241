"""Configuration and task envelopes."""

import json

import pytest

from scriptorium import config
from scriptorium.operators.catalog import Collection
from scriptorium.plans import envelopes as E

TOML = """
[vault]
path = "."
include = ["./Notes/"]
[catalog]
identity_paths = ["Notes"]
[catalog.processors.book]
required_checks = ["read_book"]
[catalog.collections.inbox]
paths = ["Inbox"]
workflow = "process-input"
processor = "book"
related = ["notes"]
[catalog.collections.notes]
paths = ["Notes"]
[scopes.all]
paths = ["."]
"""


def test_load(tmp_path, monkeypatch):
    path = tmp_path / config.FILE
    path.write_text(TOML)
    (tmp_path / "deep").mkdir()
    monkeypatch.chdir(tmp_path / "deep")
    found = config.load()
    assert found.include == ("Notes",) and [c.name for c in found.collections] == ["inbox", "notes"] and found.processors == {"book": ("read_book",)}
    config.write(str(tmp_path / "x.toml"), "/v")
    assert config.load(str(tmp_path / "x.toml")).top_k == 6
    with pytest.raises(config.ConfigError):
        config.write(str(tmp_path / "x.toml"), "/v")


@pytest.mark.parametrize(
    "change",
    [("include = [\"./Notes/\"]", "include = []"), ("\"Inbox\"", "\"../Inbox\""), ("process-input", "odd"), ("\"book\"", "\"none\""), ("\"notes\"", "\"nowhere\""), ("[vault]", "[index]\nchunk_overlap = 2000\n[vault]"), ("[vault]", "[vault")],
)
def test_rejects(tmp_path, change):
    path = tmp_path / "c.toml"
    path.write_text(TOML.replace(*change))
    with pytest.raises(config.ConfigError):
        config.load(str(path))


COLLECTIONS = [
    Collection("inbox", ("Inbox",), workflow="process-input", processor="book"),
    Collection("both", ("Inbox/Mixed",), workflow="update-note"),
    Collection("work", ("Work",), processor="ghost"),
]


def test_envelopes(spark):
    notes = spark.createDataFrame([("Inbox/a.md", None), ("Inbox/Mixed/b.md", ""), ("Work/c.md", "project"), ("Work/d.md", "x"), ("Else/e.md", None)], "path string, type string")
    got = {r.path: r for r in E.envelopes(notes, COLLECTIONS, {"book": ("read_book",), "project": ()}).collect()}
    assert (got["Inbox/a.md"].workflow, got["Inbox/a.md"].processor, got["Inbox/a.md"].ready) == ("process-input", "book", True)
    assert got["Inbox/a.md"].required_checks[3] == "register_ledger_input" and got["Inbox/a.md"].required_checks[-1] == "read_book"
    assert got["Inbox/Mixed/b.md"].blocks == ["workflow_registry_conflict", "workflow_unresolved"]
    assert got["Work/c.md"].workflow == "update-project" and got["Work/d.md"].blocks == ["processor_undefined"]
    assert got["Else/e.md"].workflow == "update-note" and got["Else/e.md"].ready
    forced = {r.path: r.blocks for r in E.envelopes(notes, COLLECTIONS, {"book": (), "project": ()}, "process-input", "move").collect()}
    assert forced["Inbox/a.md"] == [] and forced["Else/e.md"] == ["workflow_target_mismatch"]
    made = E.envelopes(notes, [], {}, action="create").first()
    assert made.blocks == ["workflow_required_for_create"] and "ensure_stable_id" in made.required_checks


def test_budget():
    out = E.within_budget({"target": "a"}, {"first": ["x" * 500] * 5, "second": ["y"] * 3}, 1300)
    assert len(out["first"]) == 2 and out["omitted"]["first"] == 3 and out["second"] == ["y"] * 3
    assert len(json.dumps(out, separators=(",", ":"))) + 16 <= 1300
    with pytest.raises(ValueError):
        E.within_budget({}, {}, 100)
