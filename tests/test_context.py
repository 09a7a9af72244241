"""Context sections by hand, and route capsules against a plain fold."""

import json
import random

import pytest

from scriptorium.operators import catalog as C
from scriptorium.operators import context as X
from scriptorium.operators import ledger as L
from scriptorium.plans.envelopes import within_budget

NOTE = "path string, title string, id string, aliases array<string>, outlinks array<string>, embeds array<string>"
PARTS = [C.Collection("a", ("A",), related=("b", "c")), C.Collection("b", ("B", "A/deep"), related=("a",))]


def test_sections(spark, tmp_path):
    rows = [("A/one.md", "One", "", ["uno", "same"], ["two", "B/x"], ["pic.png"]), ("A/two.md", "Two", "", ["same"], ["uno"], []), ("A/deep/three.md", "Three", "", [], ["uno", "uno"], [])]
    rows += [(f"B/x{i:02}.md", f"X {i}", "", [], [], []) for i in range(30)]
    notes = spark.createDataFrame(rows, NOTE)
    source = {"kind": "k", "title": "t", "canonical_key": "c", "official_root": "B"}
    units = {"u": {"source_id": "s", "inputs": [{"role": "raw", "path": "A/one.md", "presence": "present"}]}}
    ledger = L.shred(spark.createDataFrame([(7, json.dumps({"schema_version": L.FORMAT, "sources": {"s": source}, "units": units}))], "ledger int, document string"))
    foci = [("p", "path", "A/one"), ("n", "path", "ＵＮＯ"), ("m", "path", "same"), ("d", "path", "A/"), ("z", "path", "Z"), ("q", "query", "three"), ("c", "collection", "b"), ("b", "path", "B/x05.md")]
    found = X.sections(spark.createDataFrame(foci, "focus string, kind string, value string"), notes, PARTS, ledger, str(tmp_path), limit=5).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: r.position):
        got.setdefault((r.focus, r.section), []).append(r.item)
    one = {
        "outlinks": ["two", "B/x"], "embeds": ["pic.png"], "backlinks": ["A/deep/three.md", "A/two.md"], "siblings": ["A/two.md"], "reading_units": ["7/u"],
        "reading_sources": ["7/s"], "matched_collections": ["a", "b"], "related_collections": ["c"],
    }
    assert {s: items for (f, s), items in got.items() if f == "p"} == one == {s: items for (f, s), items in got.items() if f == "n"}
    assert got["m", "focus_issues"] == ["focus_ambiguous", "focus_not_found"] and got["z", "focus_issues"] == ["focus_not_found"]
    assert got["d", "children"] == ["deep:1", "one.md:1", "two.md:1"] and got["d", "matched_collections"] == ["a"]
    assert got["q", "matches"] == ["A/deep/three.md"] and got["q", "matched_collections"] == ["b", "a"] and ("q", "related_collections") in got
    assert got["c", "matched_collections"] == ["b"] and got["c", "related_collections"] == ["a"]
    assert got["b", "siblings"] == [f"B/x{i:02}.md" for i in (0, 1, 2, 3, 4)]
    cut = {(r.focus, r.section): (r.total, r.truncated) for r in found}
    assert cut["b", "siblings"] == (29, True) and cut["p", "siblings"] == (1, False)


def plain(items, budget):
    """The capsule by the driver's fold, which lays the whole JSON out for every item."""
    totals = {s: max([t for q, _, t in items if q == s], default=0) for s in X.ROUTE}
    out = {**{s: [] for s in X.ROUTE}, "omitted": dict(totals)}
    size = lambda: len(json.dumps(out, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
    for s in X.ROUTE:
        for item in [i for q, i, _ in items if q == s]:
            out[s].append(item)
            out["omitted"][s] -= 1
            if size() + X.SLACK > budget:
                out[s].pop()
                out["omitted"][s] += 1
                break
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


@pytest.mark.parametrize("budget", [420, 600, 1500])
def test_routes_equal_a_plain_fold(spark, budget):
    draw, want, rows = random.Random(budget), {}, []
    for f in range(25):
        items = []
        for s in X.ROUTE:
            n = draw.choice([0, 0, 1, 5, 12])
            total = n + draw.choice([0, 0, 3, 95, 990])
            items += [(s, draw.choice(['q"uo', "é日\\", "x" * draw.randrange(1, 70), ""]) + str(i), total) for i in range(n)]
        if items:
            want[str(f)] = plain(items, budget)
        at: dict = {}
        for s, item, total in items:
            at[s] = at.get(s, 0) + 1
            rows.append((str(f), s, at[s], item, total, False))
    frame = spark.createDataFrame(rows, "focus string, section string, position int, item string, total long, truncated boolean")
    found = {r.focus: r for r in X.routes(frame, budget, least=400).collect()}
    assert {f: r.capsule for f, r in found.items()} == want
    assert all(r.used_chars == len(r.capsule) and r.truncated == any(json.loads(r.capsule)["omitted"].values()) for r in found.values())
    with pytest.raises(ValueError):
        X.routes(frame, 100)


def test_driver_fold_agrees(spark):
    items = spark.createDataFrame([("f", s, i + 1, f"item {i}", 4, False) for s in ("matches", "outlinks") for i in range(4)], "focus string, section string, position int, item string, total long, truncated boolean")
    capsule = json.loads(X.routes(items, 500, least=400).first().capsule)
    names = sorted(X.ROUTE)
    head = within_budget({}, {s: [f"item {i}" for i in range(4)] if s in ("matches", "outlinks") else [] for s in X.ROUTE}, 500, least=400)
    assert {s: capsule[s] for s in names} == {s: head[s] for s in names}
