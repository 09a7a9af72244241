"""The ledger's rules on entries and documents, case by case, and which units a focus touches."""

import json

from scriptorium.operators import ledger as L

GOOD = {"role": "raw", "path": "a", "presence": "present"}


def units(spark, column, values):
    return spark.createDataFrame([(f"u{i}", v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], f"unit_id string, {column} string")


def test_input_entries(spark):
    sha = "aB" * 32
    kinds = {
        (None, "raw", "Inbox/x.pdf", "removed", sha.lower()): {"role": " raw\t", "path": "./Inbox\\x.pdf", "presence": "removed", "sha256": sha},
        ("ledger_path_invalid", None, None, None, None): "x",
        ("ledger_role_missing", None, None, None, None): {"role": "\u00a0", "path": "a"},
        ("ledger_path_missing", None, None, None, None): {"role": "raw", "path": " "},
        ("ledger_path_unsafe", None, None, None, None): {"role": "raw", "path": "a/../b"},
        ("ledger_presence_invalid", None, "a/b", None, None): {"role": "raw", "path": "a\\b/", "presence": ["present"]},
        ("ledger_hash_invalid", None, "a", None, None): GOOD | {"sha256": None},
    }
    rows = L.input_entries(units(spark, "inputs", [[k] for k in kinds.values()] + [{}, None, [], [GOOD, GOOD]])).collect()
    got = {r.unit_id: (r.code, r.role, r.path, r.presence, r.sha256) for r in rows}
    assert [got[f"u{i}"] for i in range(len(kinds))] == list(kinds)
    n = len(kinds)
    assert got[f"u{n}"][0] == got[f"u{n + 1}"][0] == "ledger_paths_not_array" and f"u{n + 2}" not in got
    assert [r.position for r in rows if r.unit_id == f"u{n + 3}"] == [0, 1]


def test_output_entries(spark):
    good = {"role": " official ", "path": "Notes/x.md"}
    note = "note_" + "0f" * 16
    values = [[good], [good | {"extensions": []}], [good | {"extensions": {"note_id": "n"}}], [good | {"extensions": {"note_id": note}}], [None], [{"role": "r", "path": "C:/x"}]]
    rows = {r.unit_id: (r.code, r.kept, r.role, r.note_id) for r in L.output_entries(units(spark, "outputs", values)).collect()}
    assert [rows[f"u{i}"] for i in range(6)] == [
        (None, True, "official", ""), ("ledger_output_extensions_invalid", True, "official", ""), ("ledger_note_id_invalid", True, "official", ""), (None, True, "official", note),
        ("ledger_output_invalid", False, None, None), ("ledger_path_unsafe", False, None, None),
    ]


def shredded(spark, *documents):
    texts = [d if d is None or isinstance(d, str) else json.dumps(d) for d in documents]
    return L.shred(spark.createDataFrame(list(enumerate(texts)), "ledger int, document string"))


def test_documents(spark):
    source = {"kind": "k", "title": "t", "canonical_key": "c"}
    found = shredded(
        spark, None, "{", "[]", '{"a": 1, "a": 2}', {"schema_version": L.FORMAT}, {"schema_version": 1, "sources": [], "units": []}, {"version": 1}, {"version": 1, "units": {}, "sources": {"": source}},
        {"schema_version": L.FORMAT, "sources": {"s": source | {"entry_path": 4, "inbox_roots": ["x", ""]}, "t": source}, "units": {"": {}, "u": 5}},
    )
    states = {r.ledger: r.revision.split(":")[0] for r in found.documents.collect()}
    assert states == {0: "missing", 1: "invalid", 2: "invalid", 3: "invalid", **dict.fromkeys(range(4, 9), "sha256")}
    codes = {}
    for r in found.issues.collect():
        codes.setdefault(r.ledger, []).append((r.code, r.unit_id))
    assert {k: sorted(v) for k, v in codes.items()} == {
        0: [("ledger_missing", "")], 1: [("ledger_invalid_json", "")], 2: [("ledger_invalid_root", "")], 3: [("ledger_invalid_json", "")],
        5: [("ledger_sources_not_object", ""), ("ledger_units_not_object", ""), ("ledger_version_invalid", "")], 6: [("ledger_legacy_format", "")],
        7: [("ledger_source_invalid", ""), ("ledger_units_not_array", "")],
        8: [("ledger_path_unsafe", "s"), ("ledger_path_unsafe", "s"), ("ledger_unit_id_missing", ""), ("ledger_unit_invalid", "")],
    }
    assert [(r.ledger, r.source_id) for r in found.sources.collect()] == [(8, "t")] and found.units.count() == 0


def test_legacy_units(spark):
    unit = {"unit_id": "u", "source_id": " s ", "processing_status": "odd", "cleanup_status": "gone", "raw_paths": ["a", {"path": "b", "role": 4}, 5], "official_paths": ["c", {"role": None, "path": "d"}]}
    found = shredded(spark, {"version": 1.0, "allowed_statuses": ["odd", 3], "units": [unit, unit, "x", unit | {"unit_id": "v", "processing_status": "3", "raw_paths": 1, "official_paths": 2}]})
    rows = {r.unit_id: r for r in found.units.collect()}
    assert (rows["u"].processing_status, rows["u"].cleanup_status, rows["v"].processing_status) == ("odd", "gone", "")
    assert [tuple(i) for i in rows["u"].inputs] == [("raw", "a", "", "present"), ("4", "b", "", "present")]
    assert [tuple(o) for o in rows["u"].outputs] == [("official", "c", ""), ("None", "d", "")] and rows["v"].inputs == []
    codes = sorted((r.code, r.unit_id) for r in found.issues.collect())
    assert codes == sorted([
        ("ledger_legacy_format", ""), ("ledger_unit_id_invalid", ""), ("ledger_unit_invalid", ""), ("ledger_path_invalid", "u"), ("ledger_status_unknown", "v"),
        ("ledger_paths_not_array", "v"), ("ledger_outputs_not_array", "v"),
    ])
    assert [r.source_id for r in found.sources.collect()] == ["s"]


def test_focus_joins_by_equality(spark):
    unit = {"source_id": "s", "inputs": [GOOD | {"path": "In/Deep/x.pdf"}], "outputs": [{"role": "r", "path": "old.md", "extensions": {"note_id": "note_" + "1" * 32}}]}
    source = {"kind": "k", "title": "t", "canonical_key": "c", "inbox_roots": ["Box"], "entry_path": "E/e.md"}
    found = shredded(spark, {"schema_version": L.FORMAT, "sources": {"s": source}, "units": {"u": unit}})
    identity = spark.createDataFrame([("note_" + "1" * 32, "New/now.md")], "id string, path string")
    asked = ["in", "in/deep/X.PDF", "In/Deep/x.pdf/more", "old.md", "new/now.md", "New", "Box", "bo", "e/E.md", "E"]
    met = L.matching(found, spark.createDataFrame([(a,) for a in asked], "focus string"), identity)
    assert {r.focus for r in met.collect()} == {"in", "in/deep/X.PDF", "new/now.md", "New", "Box", "e/E.md", "E"}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
