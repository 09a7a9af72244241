"""Rules of the note grammar, redaction, the ledger and the catalog, case by case."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import catalog as C
from scriptorium.operators import ledger, traces
from scriptorium.sources import vault


@pytest.mark.parametrize(
    "text, fields, body",
    [
        ("---\n\n---\nx", {}, "x"),
        ("---\na: ''\n- one\n---\nb", {"a": ["one"]}, "b"),
        ("---\na:\n- '[[N#h|x]]'\n- [[N#h|x]]\n---\n", {"a": ["[[N#h|x]]", "N"]}, ""),
        ("---\na: v\n- w\n# c\nb: [x, '[[Y|z]]', ]\nc: FALSE\n---", {"a": ["v", "w"], "b": ["x", "Y", ""], "c": False}, ""),
        ("---\n- a: 1\nk: p: q\nk: r\n---\n", {"- a": "1", "k": "r"}, ""),
        ("---\na: \"\n---\n", {"a": []}, ""),
        ("--- \nno block", {}, "--- \nno block"),
    ],
)
def test_front_matter(text, fields, body):
    assert vault.front_matter(text) == (fields, body)


def test_link_parts():
    shown = lambda x: tuple(vault.link_parts(x).values())
    assert shown("a#b#c|d|e") == ("a", "b#c", "d|e", "d|e") and shown("dir/N.v2.md") == ("dir/N.v2.md", "", "", "N.v2") and shown("a|x#y")[2] == "x#y"


def test_nothing_private_leaves(spark):
    rows = spark.createDataFrame(
        [(1, "secret words", {"action": "x", "variant": '{"path": "p"}', "workflow": "[1]", "case_id": "[no json", "query": "q"})],
        "event_id long, query string, attributes map<string,string>",
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(1)))
    out = traces.sanitize(rows).first().asDict()
    assert out["attributes"] == {"action": "x", "case_id": "[no json"} and "query" not in out and "target" not in out
    assert out["name"] == "unknown.unknown" and out["agent"] == out["status"] == "unknown" and out["content_included"] is False


def test_ledger_lists_may_be_absent(spark):
    document = spark.createDataFrame([('{"sources": {"s": {"kind": "k", "title": "t", "canonical_key": "c"}}, "units": {"u": {"source_id": "s", "processing_status": "integrated", "cleanup_status": "ready-for-cleanup"}}}',)], "document string")
    sources, units = ledger.read(document)
    notes = spark.createDataFrame([], "path string, sha256 string, id string")
    codes = {r.code for r in ledger.cross_check(units, sources, notes, notes.select("id", "path")).collect()}
    assert codes == {"ledger_integrated_without_output", "ledger_cleanup_without_raw_hash", "ledger_cleanup_without_output"}


def test_catalog_rules(spark):
    stable = "note_" + "0" * 32
    notes = spark.createDataFrame([("README.md", "", "h0"), ("a/README.md", "", "h1"), ("a/b/n.md", stable, "h2"), ("a/b/pic.png", "", "h3")], "path string, id string, sha256 string")
    found = {(r.path, r.depth, r.readme) for r in C.readmes_above(notes).collect()}
    assert found == {("a/README.md", 1, "a/README.md"), ("a/b/n.md", 1, "a/README.md"), ("a/b/pic.png", 1, "a/README.md")}
    assert tuple(C.identity_totals(notes, ("a",)).first()) == (1, 2, 0, 1) and tuple(C.identity_totals(notes.limit(0)).first()) == (0, 0, 0, 0)
    later = notes.where("path <> 'a/README.md' and path <> 'a/b/n.md'").union(spark.createDataFrame([("c/x.md", "", "h1"), ("c/y.md", stable, "h2")], notes.schema))
    assert [tuple(r) for r in C.legacy_moves(notes, later).collect()] == [("a/README.md", "c/x.md")] and C.legacy_moves(notes, later, ("a",)).count() == 0


def test_submissions_by_hand(spark):
    from scriptorium.operators import evaluation

    lists = "must_find array<string>, must_not_adopt array<string>, required_evidence array<string>"
    cases = spark.createDataFrame(
        [("c1", "complete", ["a", "b"], ["z"], ["why"]), ("c2", "target_required", None, None, None), ("c3", None, [], [], [])],
        f"case_id string, expected_status string, {lists}",
    )
    results = spark.createDataFrame(
        [
            ("x", "c1", "complete", ["a"], ["a", "b"], ["a", "b"], ["z", "z"], None), ("x", "c2", None, None, None, None, None, None),
            ("y", "c1", "complete", ["a", "b"], [], ["a"], ["a", "z"], ["why"]), ("y", "c2", None, None, None, None, None, None),
        ],
        "agent string, case_id string, status string, found array<string>, opened array<string>, returned array<string>, adopted array<string>, evidence array<string>",
    )
    metrics = {r.agent: tuple(r)[1:] for r in evaluation.submission_metrics(results, cases).collect()}
    assert metrics == {"x": (0.5, 1.0, 1, 0.0, 0.0), "y": (1.0, 0.0, 1, 1.0, 0.0)}
    broken = sorted(tuple(r)[1:] for r in evaluation.submission_failures(results, cases).where("agent = 'x'").collect())
    assert broken == [("c1", "evidence_missing", "why"), ("c1", "forbidden_relation_adopted", "z"), ("c1", "must_find_missed", "b"), ("c2", "ambiguous_target_guessed", "")]
    agreed = sorted(map(tuple, evaluation.consistency(results, cases, 2).collect()))
    assert agreed == [("c1", True, 0.5), ("c2", True, 1.0), ("c3", True, 1.0)]
    assert evaluation.submission_metrics(results.limit(0), cases).count() == 0


def test_results_are_judged_by_type(spark):
    from scriptorium.operators import evaluation

    good = '{"query": "q", "mode": "broad", "exit_code": 1, "returned_paths": ["a", 2]}'
    results = [
        '{"status": "completed", "found_paths": ["a", "a"], "opened_paths": "a", "queries": [%s, {"query": ""}], "decisions": [{"path": "a", "decision": "adopt", "reason": "r"}, {"path": "b", "decision": "defer", "reason": "r"}]}' % good,
        '{"status": 3, "queries": {}, "decisions": [{"path": "a", "decision": "adopt", "reason": "r"}, null]}', "[]", None,
    ]
    frame = spark.createDataFrame([("x", f"c{i}", r) for i, r in enumerate(results)], "agent string, case_id string, result string")
    rows = {r.case_id: r for r in evaluation.shred_results(frame).collect()}
    assert set(rows) == {"c0", "c1"}
    assert (rows["c0"].found, rows["c0"].opened, rows["c0"].returned, rows["c0"].adopted, rows["c0"].bad_queries, rows["c0"].bad_decisions) == (["a", "a"], [], ["a", "2"], ["a"], 1, False)
    assert sorted(rows["c0"].evidence) == ["decisions", "found_paths", "queries"]
    assert (rows["c1"].status, rows["c1"].adopted, rows["c1"].bad_queries, rows["c1"].bad_decisions) == (None, [], 1, True)
    none = "cast(array() as array<string>)"
    cases = spark.sql("select * from values ('c0', 'target_required'), ('c1', null), ('c2', null) t(case_id, expected_status)").selectExpr("*", f"{none} must_find", f"{none} must_not_adopt", f"{none} required_evidence")
    files = spark.createDataFrame([("a",)], "path string")
    found = evaluation.evaluation_failures(evaluation.shred_results(frame), cases, files, ["x", "y"])
    assert sorted((r.agent, r.case_id, r.code, r.item) for r in found.collect()) == sorted([
        ("x", "c0", "ambiguous_target_guessed", ""), ("x", "c0", "evidence_path_missing", "2"), ("x", "c0", "query_evidence_invalid", ""), ("x", "c0", "submission_status_mismatch", ""),
        ("x", "c1", "decision_evidence_invalid", ""), ("x", "c1", "query_evidence_invalid", ""), ("x", "c1", "submission_status_mismatch", ""), ("x", "c2", "submission_case_missing", ""),
        *[("y", f"c{i}", "submission_case_missing", "") for i in range(3)],
    ])
