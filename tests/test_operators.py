"""Operators on small fixtures: edges that the driver's tables don't hold."""

from pyspark.sql import functions as F

from scriptorium.functions import paths as P
from scriptorium.functions import text as T
from scriptorium.operators import catalog as C
from scriptorium.operators import chunks, evaluation, ledger, retrieval, traces

NOTE = "path string, title string, id string, aliases array<string>, outlinks array<string>, sha256 string"
A, B = "note_" + "a" * 32, "note_" + "b" * 32


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_tokens_and_bigrams(spark):
    assert one(spark, T.tokens(F.lit("Ab 学a习 x"))) == ["ab", "学", "a", "习", "x", "学习"]
    assert one(spark, T.tokens(F.lit("学"))) == ["学"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_fold_key(spark):
    rows = spark.createDataFrame([("STRASSE",), ("straße",), (None,)], "t string").select(T.fold_key("t").alias("k")).collect()
    assert [r.k for r in rows] == ["strasse", "strasse", ""]


def test_paths(spark):
    row = spark.createDataFrame([("a/b.c/d.md",)], "p string").select(
        P.stem(F.col("p")), P.without_suffix(F.col("p")), P.parent(F.col("p")), P.suffix(F.col("p")), P.ancestors(F.col("p"))
    ).first()
    assert tuple(row) == ("d", "a/b.c/d", "a/b.c", ".md", ["a/b.c", "a", ""])
    assert one(spark, P.under(F.lit("A/x"), F.lit("a"), fold=True)) and not one(spark, P.under(F.lit("A/x"), F.lit("a")))
    assert one(spark, P.under(F.lit("x"), F.lit("."))) and not one(spark, P.under(F.lit("x"), F.lit("."), dot=False))
    assert not one(spark, P.under(F.lit("ab"), F.lit("a")))
    assert [one(spark, P.guard(F.lit(p))) for p in ("a/b", "/a", "C:x", "a/../b", "")] == [True, False, False, False, False]
    assert one(spark, P.chunk_id(F.lit("A.md"), F.lit(12345))).endswith("::12345")


def test_front_matter_and_links(spark):
    m = one(spark, T.front_matter(F.lit("---\na: 1\nb: x: y\na: 2\n---\nbody")))
    assert m == {"a": "2", "b": "x: y"}
    assert one(spark, T.front_matter(F.lit("no block"))) == {}
    found = one(spark, T.links(F.lit("see [[A#h|b]] and ![[pic.png]] [[ C ]]")))
    assert [tuple(x) for x in found] == [(False, "A", "h", "b"), (True, "pic.png", "", ""), (False, "C", "", "")]


def test_sections(spark):
    text = "intro\n# One\nbody\n```\n# not\n```\n### Deep\nx\n## Two\n\n#no\n##### five"
    rows = chunks.sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("section").collect()
    assert [(r.section, r.heading_path) for r in rows] == [(0, ""), (1, "One"), (2, "One > Deep"), (3, "One > Two")]
    assert "# not" in rows[1].content and rows[3].content.endswith("##### five")


def test_windows():
    assert list(chunks.windows_of("", 10, 2)) == [""]
    text = "a" * 7 + "\n" + "b" * 30
    pieces = list(chunks.windows_of(text, 10, 2))
    assert pieces[0] == "a" * 7 and all(len(p) <= 10 for p in pieces)
    assert list(chunks.windows_of("x" * 25, 10, 10))  # an overlap as long as the window still ends
    assert list(chunks.windows_of(" " * 30, 10, 2)) == []


def notes(spark, rows):
    return spark.createDataFrame(rows, NOTE)


def test_links_and_identity(spark):
    n = notes(spark, [
        ("a/one.md", "One", A, ["first"], ["two", "first", "", "x/y", "two.md"], "1"),
        ("b/two.md", "Two", A, ["first"], ["../a", "one"], "2"),
        ("c/three.txt", None, None, None, None, "3"),
    ])
    got = {(r.path, r.ord): (r.status, r.resolved) for r in C.resolve_links(n).collect()}
    assert got[("a/one.md", 0)] == ("unique", "b/two.md") and got[("a/one.md", 4)] == ("unique", "b/two.md")
    assert got[("a/one.md", 1)] == ("ambiguous", "a/one.md")
    assert got[("a/one.md", 2)] == ("unique", "a/one.md") and got[("a/one.md", 3)] == ("unresolved", "")
    states = {r.state: r.files for r in C.identity_summary(n).collect()}
    assert states == {"stable": 2, "not-applicable": 1}
    assert C.identity_index(n).count() == 0 and C.duplicate_ids(n).first().files == 2


def test_find_modes(spark):
    n = notes(spark, [("a/Plan.md", "Plan", A, [], [], ""), ("a/Plan two.md", "x", B, ["plan"], [], "")])
    assert [(r.path, r.score) for r in C.find(n, ["plan"]).orderBy(F.desc("score")).collect()] == [("a/Plan.md", 98), ("a/Plan two.md", 97)]
    assert [r.path for r in C.find(n, ["plan"], exact=True).collect()] == ["a/Plan.md"]
    assert C.find(n, [A]).first().score == 110
    page = C.find_page(n, "pla", 1).first()
    assert page.total == 2 and page.position == 1


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3")], "path string, sha256 string")
    assert {r.path: r.change for r in C.snapshot_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    assert [tuple(r) for r in C.possible_moves(old, new).collect()] == [("c", "d")]
    assert C.digest(old, "path", "sha256").first() == C.digest(old.orderBy(F.desc("path")), "path", "sha256").first()
    assert C.digest(old, "path", "sha256").first() != C.digest(new, "path", "sha256").first()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert retrieval.hybrid(none, asked).count() == 0
    assert retrieval.corpus_stats(retrieval.lengths(none)).first().avg_len == 1.0
    assert C.issues(notes(spark, []), []).count() == 0


def test_hash_vectors_are_unit(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "!!"), (3, None)], "doc_id long, text string")
    sums = retrieval.hash_vectors(docs).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r.doc_id for r in sums} == {1, 2, 3} and all(abs(r.s - 1) < 1e-6 for r in sums)


def test_ledger(spark):
    doc = '{"sources": {"s1": {"kind": "book"}}, "units": {"u1": {"source_id": "zz", "processing_status": "verified", "cleanup_status": "odd", "inputs": [{"role": "raw", "path": "gone.md", "presence": "present"}], "outputs": []}}}'
    sources, units = ledger.read(spark.createDataFrame([(doc,), ("{broken",)], "document string"))
    n = notes(spark, [("a.md", "A", A, [], [], "1")])
    codes = {r.code for r in ledger.cross_check(units, sources, n, C.identity_index(n)).collect()}
    assert codes == {"ledger_source_unknown", "ledger_integrated_without_output", "ledger_path_missing"}
    assert units.first().cleanup_status == ""


def test_traces(spark):
    rows = spark.createDataFrame(
        [(1, "s", "a", -5.0, {"action": "x", "secret": "y"}), (2, "s", "a", 1.5, None), (3, "s", "b", None, {}), (4, "t", None, 0.0, {})],
        "event_id long, session_key string, target_path string, duration_ms double, attributes map<string,string>",
    ).withColumns({"timestamp": F.timestamp_seconds(F.lit(1)), "component": F.lit("rag"), "operation": F.lit("op"), "target": F.lit("p")})
    clean = traces.sanitize(rows).orderBy("event_id").collect()
    assert clean[0].attributes == {"action": "x"} and "target" not in clean[0].asDict() and clean[1].attributes == {}
    spans = {r.event_id: r.end_ns - r.start_ns for r in traces.spans(rows).collect()}
    assert spans == {1: 0, 2: 1_500_000, 3: 0, 4: 0}
    steps = {r.event_id: r.step for r in traces.session_steps(rows).collect()}
    assert steps == {1: "start", 2: "reuse", 3: "supersede", 4: "start"}


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "q int, d int, rank int")
    good = spark.createDataFrame([(1, 6)], "q int, d int")
    assert {r.q: r.reciprocal_rank for r in evaluation.reciprocal_rank(ranked, good, "q", "d").collect()} == {1: 0.5, 2: 0.0}
    cases = spark.createDataFrame([("m", "passed"), ("m", "skipped"), ("n", "skipped")], "metric string, status string")
    assert {r.metric: r.rate for r in evaluation.rollup(cases).collect()} == {"m": 1.0, "n": None}


def test_bm25_shuffles_nothing_of_a_document_and_keeps_ties(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same words "), F.col("id") % 3).alias("text"), F.when(F.col("id") % 2 == 0, "a").alias("scope"))
    asked = spark.createDataFrame([(1, "same 2 same"), (2, "words"), (3, "none")], "item_id long, text string")
    found = retrieval.bm25(docs, asked, best=2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    order = lambda rows: [tuple(r) for r in retrieval.top(rows, 2, "item_id").orderBy("item_id", "rank").select("item_id", "doc_id", "score").collect()]
    assert order(found) == order(retrieval.bm25(docs, asked)) and [x[:2] for x in order(found)] == [(1, 2), (1, 5), (2, 0), (2, 1)]
    scoped = retrieval.bm25(docs, asked, scope_col="scope")
    assert {r.scope for r in scoped.select("scope").distinct().collect()} == {"a"} and scoped.count() == 2 * 2500


def test_backlinks_under_common_names(spark):
    import random

    draw = random.Random(5)
    names = [f"n{i}" for i in range(9)]
    rows = [(f"p{i}.md", f"T{i}", f"id{i % 40}", draw.sample(names, i % 4), [*draw.choices(names, k=i % 6), f"p{i * 7 % 61}", f"ID{i % 50}"]) for i in range(60)]
    notes = spark.createDataFrame(rows, "path string, title string, id string, aliases array<string>, outlinks array<string>")
    hits = C.edges(notes).select(F.col("path").alias("source"), "key").join(C.lookup(notes), "key").select("source", "path").distinct()
    want = {tuple(r) for r in hits.groupBy("path").count().collect()}
    for crowd in (0, 1, 5, 1000):
        assert {tuple(r) for r in C.backlinks(notes, crowd).collect()} == want
    many = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("").alias("title"), F.lit("").alias("id"), F.array(F.lit("same")).alias("aliases"), F.array(F.lit("same")).alias("outlinks"))
    assert C.backlinks(many).agg(F.min("backlinks"), F.max("backlinks"), F.count("path")).first() == (20_000, 20_000, 20_000)  # 400 million pairs
