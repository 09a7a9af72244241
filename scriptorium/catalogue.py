"""The registry of queries over the driver's tables and the SQL they are held against.

The tables stand in for a vault: each of ``documents`` is a note whose path, front matter, id,
aliases and links are derived from its columns by arithmetic, ``pages`` give headings,
``benchmark`` the queries, ``events`` the traces and ``labels`` the judgements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracles
from .functions import paths as P
from .functions import text as T
from .operators import catalog as C
from .operators import catalog_sync as CS
from .operators import chunk_index, chunks, context, digests, evaluation, ledger, projections, retrieval, traces
from .plans import envelopes
from .session import attach
from .storage import workspace, written

COLLECTIONS = [
    C.Collection("sources", ("Sources",), related=("english", "archive")),
    C.Collection("english", ("sources/EN",), entrypoints=("Sources/en/README.md",), related=("romance",)),
    C.Collection("romance", ("Sources/fr", "Sources/es", "Sources/it"), related=("english", "sources")),
    C.Collection("first", ("Sources/en/src1", "Sources/de/src1")),
    C.Collection("archive", ("Archive",)),
]
QUERIES = ["doc_12", "Doc 7", "d42", "sources/en/src1", "SRC3/doc_1", "doc 99"]
PREFIXES = ["Sources", "Sources/en"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """path, title, id, aliases, outlinks, sha256 of every document as a note, and more of its columns."""
    d = _read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    path = F.concat(F.lit("Sources/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/doc_"), n, F.lit(".md"))
    note = lambda x: F.concat(F.lit("note_"), F.md5(x.cast("string").cast("binary")))
    own = F.when(n % 10 == 0, "").when(n % 10 == 5, F.concat(F.lit("NOTE-"), n)).when(n % 50 == 1, note(-F.floor(n / 100) - 1)).otherwise(note(n))
    targets = F.array(
        F.concat(F.lit("doc_"), n + 1), F.concat(F.lit("Doc "), n * 7), F.concat(F.lit("d"), n % 397), F.concat(F.lit("doc_"), n - 1, F.lit(".md")),
        F.concat(F.lit("../x/doc_"), n),
    )
    return d.select(
        path.alias("path"), F.concat(F.lit("Doc "), n).alias("title"), own.alias("id"), F.array(F.concat(F.lit("d"), n % 397)).alias("aliases"),
        targets.alias("outlinks"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), n.alias("doc_id"), *more,
    )


def _edited(notes: DataFrame) -> DataFrame:
    """A later snapshot: some notes deleted, moved or changed."""
    n = F.col("doc_id")
    kept = notes.where((n % 11 != 0) | n.isNull())
    return kept.select(
        F.when(n % 17 == 0, F.concat(F.lit("Moved/doc_"), n, F.lit(".md"))).otherwise(F.col("path")).alias("path"),
        F.when(n % 7 == 0, F.sha2(F.concat("sha256", F.lit("!")), 256)).otherwise(F.col("sha256")).alias("sha256"),
    )


def tokenize_docs(spark, sf):
    found = _read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def term_freq(spark, sf):
    return retrieval.postings(_read(spark, sf, "documents"))


def doc_freq(spark, sf):
    return retrieval.postings(_read(spark, sf, "documents")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(spark, sf):
    return retrieval.corpus_stats(retrieval.lengths(_read(spark, sf, "documents"))).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def bm25_topk(spark, sf):
    found = retrieval.bm25(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"), best=10)
    return retrieval.top(found, 10, "item_id").select("item_id", "doc_id", "rank", "score")


def bm25_scoped(spark, sf):
    docs = _read(spark, sf, "documents").withColumn("scope", F.coalesce("lang", F.lit("xx")))
    found = retrieval.bm25(docs, _read(spark, sf, "benchmark"), scope_col="scope", best=5)
    return retrieval.top(found, 5, "item_id", "scope").select("item_id", "scope", "doc_id", "rank", "score")


def hash_embed_dims(spark, sf):
    return retrieval.hash_vectors(_read(spark, sf, "documents")).select("doc_id", "dim", "weight")


def dense_topk_vectors(spark, sf):
    rows = _read(spark, sf, "embeddings").where("embedding is not null and label is not null")
    dims = F.transform("embedding", lambda _, i: i)
    vectors = rows.select(F.col("vec_id").alias("doc_id"), dims.alias("dims"), F.transform("embedding", lambda x: x.cast("double")).alias("weights"))
    cells = rows.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("weight"))
    means = retrieval.gathered(cells.withColumnRenamed("label", "item_id"), "item_id")
    width = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]
    near = retrieval.dense(vectors, means.select(F.col("item_id").cast("long"), "dims", "weights"), 6, width)
    return retrieval.top(near, 6, "item_id").select("item_id", "doc_id", "rank", "score")


def hybrid_topk(spark, sf):
    return retrieval.hybrid(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def split_windows(spark, sf):
    found = chunks.split_windows(_read(spark, sf, "documents"))
    return found.select("doc_id", "piece", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _page_notes(spark, sf):
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"<h([1-6])>", "\n<h$1>")
    text = html
    for level in range(1, 5):
        text = F.regexp_replace(text, rf"<h{level}>([^<\n]*)</h{level}>", "#" * level + " $1\n")
    return _read(spark, sf, "pages").select("page_id", text.alias("text"))


def heading_sections(spark, sf):
    found = chunks.sections(_page_notes(spark, sf), "page_id")
    return found.select("page_id", F.col("section").cast("int").alias("section"), "heading_path", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def extract_links(spark, sf):
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r'<a href="([^"]*)">([^<]*)</a>', "[[$1|$2]]")
    found = _read(spark, sf, "pages").select("page_id", F.posexplode(T.links(text)).alias("ord", "l"))
    return found.select("page_id", "ord", "l.target", "l.heading", "l.alias")


def resolve_links(spark, sf):
    return C.resolve_links(_notes(spark, sf))


def backlink_counts(spark, sf):
    return C.backlinks(_notes(spark, sf))


def match_tiers(spark, sf):
    return C.find(_notes(spark, sf), QUERIES)


def find_exact(spark, sf):
    return C.find(_notes(spark, sf), QUERIES, exact=True)


def find_page(spark, sf):
    return C.find_page(_notes(spark, sf), "doc_1", 20)


def resolve_path(spark, sf):
    return C.resolve(_notes(spark, sf), ["sources/EN/src0/DOC_0", "Sources/en/src1/doc_1.md", "no/such"])


def collection_membership(spark, sf):
    return C.membership(_notes(spark, sf), COLLECTIONS)


def primary_collection(spark, sf):
    found = C.with_collections(_notes(spark, sf), COLLECTIONS)
    return found.groupBy("primary_collection").agg(F.count(F.lit(1)).alias("files"))


def collection_summary(spark, sf):
    return C.collection_summary(C.membership(_notes(spark, sf), COLLECTIONS))


def child_counts(spark, sf):
    return C.child_counts(_notes(spark, sf), PREFIXES)


def related_collections(spark, sf):
    found = C.related(C.membership(_notes(spark, sf), COLLECTIONS), COLLECTIONS)
    return found.groupBy("collection").agg(F.count(F.lit(1)).alias("files"))


def readme_ancestors(spark, sf):
    notes = _notes(spark, sf).select("path")
    readmes = notes.select(F.concat(P.parent(F.col("path")), F.lit("/README.md")).alias("path")).distinct()
    top = notes.sparkSession.createDataFrame([("README.md",), ("Sources/README.md",)], "path string")
    return C.readmes_above(notes.union(readmes).union(top))


def identity_totals(spark, sf):
    return C.identity_totals(_notes(spark, sf), ("Sources/en",))


def legacy_moves(spark, sf):
    notes, n = _notes(spark, sf), F.col("doc_id")
    later = notes.where((n % 11 != 0) | n.isNull()).withColumn("path", F.when(n % 17 == 0, F.concat(F.lit("Moved/doc_"), n, F.lit(".md"))).otherwise(F.col("path")))
    return C.legacy_moves(notes, later)


def issue_bag(spark, sf):
    """The catalog's own issues with those of the ledgers, whose units stand as targets."""
    more = ledger.shred(_ledgers(spark, sf)).issues.withColumnRenamed("unit_id", "target")
    return C.issue_bag(_notes(spark, sf), COLLECTIONS, ("Sources/en",), more)


def issue_totals(spark, sf):
    return C.issue_totals(issue_bag(spark, sf))


def frontmatter_fields(spark, sf):
    d = _read(spark, sf, "documents")
    raw = F.concat(
        F.lit("---\ntitle: Doc "), F.col("doc_id"), F.lit("\ntype: "), F.coalesce("lang", F.lit("")), F.lit("\n# note\narea:  "), F.coalesce("source", F.lit("")),
        F.lit("\ntags: [a"), F.col("doc_id") % 3, F.lit(", b]\ntitle: Last "), F.col("doc_id"), F.lit("\n---\n"), F.coalesce("text", F.lit("")),
    )
    m = d.select("doc_id", T.front_matter(raw).alias("m"))
    return m.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["type"].alias("type"), F.col("m")["area"].alias("area"), F.array_join(T.list_items(F.col("m")["tags"]), "|").alias("tags"), F.size("m").alias("fields"))


def duplicate_ids(spark, sf):
    return C.duplicate_ids(_notes(spark, sf))


def ambiguous_names(spark, sf):
    return C.ambiguous_names(_notes(spark, sf))


def snapshot_diff(spark, sf):
    notes = _notes(spark, sf)
    return C.snapshot_diff(notes, _edited(notes)).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


def chunk_audit(spark, sf):
    pieces = chunks.split_windows(_read(spark, sf, "documents"))
    name = P.chunk_id(F.concat(F.lit("Doc_"), F.col("doc_id")), F.col("piece"))
    want = pieces.select(name.alias("chunk_id"))
    have = pieces.where("doc_id % 13 <> 0").select(F.when(F.col("piece") == 2, F.concat(name, F.lit("x"))).otherwise(name).alias("chunk_id"))
    return C.chunk_audit(want, have)


def content_digest(spark, sf):
    return C.digest(_notes(spark, sf), "path", "sha256")


def ledger_cross_check(spark, sf):
    notes = _notes(spark, sf)
    n = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("captured", "integrated", "verified", "blocked"))), (n % 4 + 1).cast("int"))
    clean = F.element_at(F.array(*map(F.lit, ("not-ready", "ready-for-cleanup", "raw-and-draft-cleaned"))), (n % 3 + 1).cast("int"))
    sha = F.when(n % 5 == 0, F.lit("")).when(n % 5 == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256"))
    presence = F.when(n % 7 == 0, "removed").when(n % 7 == 1, "unknown").otherwise("present")
    path = F.when(n % 6 == 0, F.concat(F.lit("Gone/"), n)).otherwise(F.col("path"))
    inputs = F.array(F.struct(F.when(n % 2 == 0, "raw").otherwise("other").alias("role"), path.alias("path"), sha.alias("sha256"), presence.alias("presence")))
    out = F.struct(F.lit("official").alias("role"), path.alias("path"), F.when(n % 3 == 0, F.col("id")).otherwise("").alias("note_id"))
    units = notes.select(
        F.concat(F.lit("u"), n).alias("unit_id"), F.concat(F.lit("s"), n % 9).alias("source_id"), status.alias("processing_status"), clean.alias("cleanup_status"),
        inputs.alias("inputs"), F.when(n % 8 == 0, F.filter(F.array(out), lambda _: F.lit(False))).otherwise(F.array(out)).alias("outputs"),
    )
    sources = notes.sparkSession.range(7).select(F.concat(F.lit("s"), F.col("id")).alias("source_id"))
    found = ledger.cross_check(units, sources, notes, C.identity_index(notes))
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("issues"), F.min("unit_id").alias("first_unit"), F.count_if(F.col("target") != "").alias("with_target"))


def envelope_routes(spark, sf):
    notes = _notes(spark, sf).withColumn("type", F.when(F.col("doc_id") % 23 == 0, "project").otherwise("note"))
    parts = [
        C.Collection("german", ("Sources/de",), workflow="process-input", processor="book"),
        C.Collection("first", ("Sources/de/src1", "Sources/fr/src1"), workflow="update-note", processor="ghost"),
        C.Collection("french", ("Sources/fr",), processor="book"),
    ]
    found = envelopes.envelopes(notes, parts, {"book": ("read_book", "validate"), "project": ("read_plan",)})
    return found.select("path", "workflow", "processor", F.array_join("blocks", ",").alias("blocks"), F.array_join("required_checks", ",").alias("required_checks"), "ready")


def _traces(spark, sf):
    e = _read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").alias("session_key"), F.when(F.col("event_id") % 3 == 0, "rag").otherwise("task").alias("component"),
        F.col("event_type").alias("operation"), F.lit("ok").alias("status"), F.col("value").alias("duration_ms"),
        F.create_map(F.lit("action"), F.col("event_type"), F.lit("k"), k, F.lit("result_count"), k, F.lit("secret"), F.lit("x")).alias("attributes"), F.lit(None).cast("string").alias("target"),
    )


def event_redaction(spark, sf):
    found = traces.sanitize(_traces(spark, sf))
    return found.select("event_id", "name", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys"), F.col("attributes")["result_count"].alias("result_count"))


def event_redaction_typed(spark, sf):
    """Attributes as JSON: scalars, texts that look nested, nested values, and some that repeat a key."""
    e = _read(spark, sf, "events")
    n, k = F.col("event_id"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    action = F.when(n % 5 == 0, F.lit('"[1]"')).when(n % 5 == 1, F.lit('{"a": "secret"}')).when(n % 5 == 2, F.lit('{"a": 1, "a": "secret"}')).when(n % 5 == 3, F.lit("null")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    json = F.concat(F.lit('{"action": '), action, F.lit(', "result_count": '), k, F.lit(', "secret": "x", "variant": ["y"]}'))
    rows = e.select("event_id", F.lit("rag").alias("component"), F.col("event_type").alias("operation"), F.try_parse_json(json).alias("attributes"))
    found = traces.sanitize(rows)
    keys = F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys")
    return found.select("event_id", keys, F.col("attributes")["action"].alias("action"), F.col("attributes")["result_count"].alias("result_count"))


def event_spans(spark, sf):
    return traces.spans(_traces(spark, sf)).select("event_id", "start_ns", "end_ns", "span_kind")


def session_supersede(spark, sf):
    found = traces.session_steps(_traces(spark, sf), target="operation")
    return found.groupBy("session_key", "step").agg(F.count(F.lit(1)).alias("steps"))


def pending_events(spark, sf):
    rows = _read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("file"))
    lines = rows.withColumn("line", F.row_number().over(W.partitionBy("file").orderBy("event_id")))
    cursors = lines.groupBy("file").agg(F.floor(F.max("line") / 3).alias("acked")).where("day(to_date(file)) % 2 = 0")
    left = traces.pending(lines, cursors)
    return left.groupBy("file").agg(F.count(F.lit(1)).alias("pending"), F.min("event_id").alias("first_event"))


def _adopted(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "n_chars")
    good = _read(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    return d, d.join(good, "doc_id"), d.where("n_chars > 1000")


def eval_recall(spark, sf):
    _, wanted, found = _adopted(spark, sf)
    return evaluation.recall(wanted, found, "source", "doc_id")


def eval_jaccard(spark, sf):
    docs, a, b = _adopted(spark, sf)
    both = a.select("source", "doc_id", F.lit("a").alias("agent")).union(b.select("source", "doc_id", F.lit("b")))
    return evaluation.jaccard(both, "source", "doc_id", "agent", 2, docs)


def eval_rollup(spark, sf):
    rows = _read(spark, sf, "labels").select(
        F.concat(F.lit("m"), F.col("doc_id") % 4).alias("metric"),
        F.when(F.col("doc_id") % 5 == 0, "skipped").when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"),
    )
    return evaluation.rollup(rows)


def _submissions(spark, sf):
    """Cases by document, and the results of two agents, one of which leaves some out."""
    d = _read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("case_id"))
    n = F.col("doc_id")
    names = lambda first, step, k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.concat(F.lit("p"), (n * first + i * step) % 11))
    cases = d.select(
        "case_id", F.when(n % 4 == 0, "target_required").otherwise("complete").alias("expected_status"), names(2, 3, 3).alias("must_find"),
        names(5, 1, 2).alias("must_not_adopt"), F.when(n % 2 == 0, F.array(F.lit("reason"), F.lit("links"))).alias("required_evidence"),
    )
    agents = spark.createDataFrame([("a", 1), ("b", 2)], "agent string, k int")
    k = F.col("k")
    item = lambda x: F.concat(F.lit("p"), x % 11)
    found = d.join(F.broadcast(agents), (k == 1) | (n % 5 != 0)).select(
        "agent", "case_id", F.when(n % (k * 8) == 0, "complete").otherwise("target_required").alias("status"), F.array(item(n * 2), item(n * 2 + 3)).alias("found"),
        F.array(item(n * 2 * k), item(n * 2)).alias("opened"), F.array(item(n * 2 + 6)).alias("returned"), F.array(item(n * 5), item(n * k)).alias("adopted"),
        F.when(n % 6 == 0, F.array(F.lit("reason"))).alias("evidence"),
    )
    return found, cases


def eval_submissions(spark, sf):
    return evaluation.submission_metrics(*_submissions(spark, sf))


def eval_failures(spark, sf):
    return evaluation.submission_failures(*_submissions(spark, sf))


def eval_consistency(spark, sf):
    return evaluation.consistency(*_submissions(spark, sf), 2)


def link_counts(spark, sf):
    n = F.col("doc_id")
    some = lambda k: F.slice("outlinks", F.lit(1), (n % k).cast("int"))
    return C.link_counts(_notes(spark, sf).withColumn("embeds", some(3)).withColumn("outlinks", some(6)), 2)


def find_within(spark, sf):
    notes = _notes(spark, sf).withColumn("type", F.when(F.col("doc_id") % 2 == 0, "Book").otherwise("note"))
    return C.find(C.within(notes, COLLECTIONS, "english", "Sources/en", "book"), ["doc_1", "doc_", "src1"])


def warning_codes(spark, sf):
    return C.warning_codes(C.issues(_notes(spark, sf), COLLECTIONS, ("Sources/en",)))


def ledger_inputs(spark, sf):
    """An input for every note: its path, hash and source, some of them spoilt."""
    n = F.col("doc_id")
    path = F.when(n % 6 == 0, F.concat(F.lit("../"), "path")).otherwise(F.concat(F.lit("./"), "path"))
    presence = F.element_at(F.array(*map(F.lit, ("present", "removed", "unknown", "gone"))), (n % 4 + 1).cast("int"))
    sha = F.when(n % 5 == 0, F.substring("sha256", 1, 63)).otherwise(F.upper("sha256"))
    item = F.struct(F.concat(F.lit(" "), F.split("path", "/")[2], F.lit(" ")).alias("role"), path.alias("path"), presence.alias("presence"), sha.alias("sha256"))
    inputs = F.when(n % 7 == 0, F.to_json(item)).otherwise(F.to_json(F.array(item, item)))
    return ledger.input_entries(_notes(spark, sf).select(F.concat(F.lit("u"), n).alias("unit_id"), inputs.alias("inputs")))


def ledger_outputs(spark, sf):
    """An output for every note: its path and id, well formed or not, some extensions no objects."""
    n = F.col("doc_id")
    role = F.when(n % 9 == 0, " ").otherwise(F.split("path", "/")[1])
    item = F.struct(role.alias("role"), F.col("path").alias("path"), F.struct(F.col("id").alias("note_id")).alias("extensions"))
    odd = F.struct(role.alias("role"), F.col("path").alias("path"), F.col("id").alias("extensions"))
    outputs = F.when(n % 7 == 0, F.to_json(item)).when(n % 4 == 1, F.to_json(F.array(odd))).otherwise(F.to_json(F.array(item)))
    return ledger.output_entries(_notes(spark, sf).select(F.concat(F.lit("u"), n).alias("unit_id"), outputs.alias("outputs")))


LAYOUT = chunk_index.Layout(buckets=8, shelves=8)
_SYNC = ("scanned", "changed", "deleted", "chunks_upserted", "chunks_deleted")


def _vault(spark, sf):
    """Every document as a note with its text and fields."""
    found = _notes(spark, sf, "text", "source", "lang")
    return found.select("path", "title", "sha256", "text", F.col("source").alias("area"), F.col("lang").alias("type"), "doc_id")


def _edited_vault(spark, sf):
    """A later state: some notes deleted, moved or with more text."""
    n = F.col("doc_id")
    text = F.when(n % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" more"))).otherwise(F.col("text"))
    path = F.when(n % 17 == 0, F.concat(F.lit("Moved/doc_"), n, F.lit(".md"))).otherwise(F.col("path"))
    return _vault(spark, sf).where(n % 11 != 0).withColumns({"text": text, "path": path}).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def _searched(spark, sf, prefixes=()):
    store = workspace(spark, "chunk-index")
    chunk_index.sync(_vault(spark, sf), store, LAYOUT)
    found = chunk_index.search(spark, store, _read(spark, sf, "benchmark"), prefixes, LAYOUT)
    return found.select("item_id", "chunk_id", "path", "piece", "rank", "score")


def chunk_search(spark, sf):
    return _searched(spark, sf)


def chunk_search_scoped(spark, sf):
    return _searched(spark, sf, ("Sources/en", "Sources/fr/src1"))


def index_sync(spark, sf):
    store = workspace(spark, "chunk-index")
    done = [chunk_index.sync(notes(spark, sf), store, LAYOUT) for notes in (_vault, _edited_vault, _edited_vault)]
    rows = [(i, *(x[c] for c in _SYNC)) for i, x in enumerate(done)]
    return spark.createDataFrame(rows, "sync int, " + ", ".join(f"{c} long" for c in _SYNC))


def index_audit(spark, sf):
    """Right after a sync, and against notes that have changed since."""
    store = workspace(spark, "chunk-index")
    chunk_index.sync(_vault(spark, sf), store, LAYOUT)
    found = [chunk_index.audit(spark, store, notes(spark, sf), LAYOUT) for notes in (_vault, _edited_vault)]
    names = ("files", "chunks", "missing_chunks", "orphaned_chunks", "storage_consistent", "pipeline_current", "fresh", "ready")
    kinds = ", ".join(f"{c} {'long' if i < 4 else 'boolean'}" for i, c in enumerate(names))
    return spark.createDataFrame([(i, *(x[c] for c in names)) for i, x in enumerate(found)], "audit int, " + kinds)


_SHA = "aB" * 32
# What the ledgers derived from documents hold, # standing for the id: by the id's remainder.
_SOURCES = (
    '{"kind": " book ", "title": "T#", "canonical_key": "k", "inbox_roots": ["./Inbox/#", "a\\\\b/"], "entry_path": null}',
    '{"kind": "book", "title": " ", "inbox_roots": []}', '{"kind": "book", "title": "T#", "canonical_key": "k", "inbox_roots": "x"}',
    '{"kind": "book", "title": "T#", "canonical_key": "k", "inbox_roots": ["ok", "../up", 5]}',
    '{"kind": "book", "title": "T#", "canonical_key": "k", "official_root": "/abs", "entry_path": "Notes/#.md"}', "5",
)
_STATUS, _CLEANUP = ('"done"', "[]", '"captured"', '"verified"', '"blocked"'), ("{}", '"not-ready"', '"unknown"', '"ready-for-cleanup"')
_ORIGIN = (
    '"x"', '{"basis": [1], "confidence": "exact"}', '{"basis": ["b", "c"], "confidence": "sure"}', "{}", '{"basis": ["b"], "confidence": "reviewed"}', '{"confidence": "exact"}',
)
_INPUTS = (
    '[{"role": " raw ", "path": "./Inbox\\\\#.pdf", "presence": "removed", "sha256": "%s"}]' % _SHA, '{"role": "raw"}', '["x", {"role": 3, "path": "a"}]',
    '[{"role": " ", "path": "a"}, {"role": "raw", "path": " "}, {"role": "raw", "path": "a/../#"}]', '[{"role": "raw", "path": "b/#/", "presence": "gone"}]', "[]",
    '[{"role": "raw", "path": "c/#", "presence": "present", "sha256": "zz"}, {"role": "draft", "path": "d/#", "presence": "present", "sha256": null}, {"role": "draft", "path": "e/#", "presence": "unknown"}]',
)
_OUTPUTS = (
    '[{"role": "official", "path": "Notes/#.md"}]', "7", '[null, {"role": " official\\t", "path": "N/#", "extensions": []}]', '[{"role": "x", "path": "N/#", "extensions": {"note_id": "n#"}}]',
    '[{"role": "official", "path": "N/#", "extensions": {"note_id": "note_%s"}}, {"role": "official", "path": "C:/x"}]' % ("0f" * 16),
)


def _ledgers(spark, sf):
    """A ledger for every 20 documents, some in the legacy form, some unreadable; each document gives a source and a unit."""
    n = F.col("doc_id")
    pick = lambda kinds: F.replace(F.element_at(F.array(*map(F.lit, kinds)), (n % len(kinds) + 1).cast("int")), F.lit("#"), n.cast("string"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    named = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("s"), n))
    unit = text(
        '{"source_id": "', named, '", "kind": ', F.when(n % 8 == 0, "7").otherwise('"chapter"'), ', "scope": ', F.when(n % 9 == 0, "[]").otherwise('{"label": "x"}'),
        ', "processing_status": ', pick(_STATUS), ', "cleanup_status": ', pick(_CLEANUP), ', "provenance": ', pick(_ORIGIN), ', "issues": ', F.when(n % 11 == 0, "[1]").otherwise('["i"]'),
        ', "inputs": ', pick(_INPUTS), ', "outputs": ', pick(_OUTPUTS), "}",
    )
    old = text(
        '{"unit_id": "', F.when(n % 13 == 0, "again").otherwise(F.concat(F.lit("u"), n)), '", "source_id": "', named, ' ", "processing_status": ', pick(_STATUS), ', "cleanup_status": ', pick(_CLEANUP),
        ', "raw_paths": ["R/', n.cast("string"), '", {"path": "S/', n.cast("string"), '", "state": "removed"}], "draft_paths": ', F.when(n % 4 == 1, "5").otherwise("[]"),
        ', "official_paths": [{"path": "O/', n.cast("string"), '"}, 6]}',
    )
    rows = _read(spark, sf, "documents").where("doc_id is not null").select(
        F.floor(n / 20).alias("ledger"), "doc_id", text('"s', n.cast("string"), '": ', pick(_SOURCES)).alias("source"), text('"u', n.cast("string"), '": ', unit).alias("unit"), old.alias("old")
    )
    lists = rows.groupBy("ledger").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c))), lambda x: x[c]), ", ").alias(c) for c in ("source", "unit", "old")))
    form = F.col("ledger") % 9
    version = F.when(form == 3, "x").otherwise(ledger.FORMAT)
    modern = text('{"schema_version": "', version, '", "sources": {', F.col("source"), '}, "units": {', F.col("unit"), "}}")
    legacy = text('{"version": 1, "allowed_statuses": ["captured", "verified"], "units": [', F.col("old"), "]}")
    document = F.when(form == 8, "not json").when(form == 7, "[1]").when(form != 6, F.when(form.isin(4, 5), legacy).otherwise(modern))
    return lists.select("ledger", document.alias("document"))


def ledger_documents(spark, sf):
    return ledger.shred(_ledgers(spark, sf)).documents.select("ledger", F.regexp_replace("revision", "[0-9a-f]{64}", "hash").alias("state"))


def ledger_sources(spark, sf):
    found = ledger.shred(_ledgers(spark, sf)).sources
    return found.withColumn("inbox_roots", F.array_join("inbox_roots", "|"))


def ledger_units(spark, sf):
    found = ledger.shred(_ledgers(spark, sf)).units
    joined = lambda c, *names: F.array_join(F.transform(c, lambda e: F.concat_ws(":", *(e[n] for n in names))), "|").alias(c)
    return found.select(
        "ledger", "unit_id", "source_id", "kind", "scope", "processing_status", "cleanup_status", F.array_join("basis", "|").alias("basis"), "confidence", F.array_join("issues", "|").alias("issues"),
        joined("inputs", "role", "path", "sha256", "presence"), joined("outputs", "role", "path", "note_id"),
    )


def ledger_issues(spark, sf):
    return ledger.shred(_ledgers(spark, sf)).issues


def ledger_focus(spark, sf):
    focus = spark.createDataFrame([("inbox/1",), ("Notes",), ("N",), ("notes/4.MD",), ("a/b",), ("R",), ("C/6",)], "focus string")
    notes = _notes(spark, sf)
    identity = notes.select(F.lit("note_" + "0f" * 16).alias("id"), F.lit("Now/here.md").alias("path")).limit(1)
    return ledger.matching(ledger.shred(_ledgers(spark, sf)), focus.union(spark.createDataFrame([("Now",)], "focus string")), identity)


def _files(spark, sf, later=False):
    """Every document as a Markdown file (path, file, kind, extension, size, modified, content); later some moved, edited, touched, spoilt or gone."""
    n = F.col("doc_id")
    notes = _edited_vault(spark, sf) if later else _vault(spark, sf)
    ids = _notes(spark, sf).select("doc_id", "id")
    rows = notes.join(ids, "doc_id")
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\ntitle: Doc "), n, F.lit("\n---\n"))
    content = F.concat(head, F.coalesce("text", F.lit(""))).cast("binary")
    stamp = F.timestamp_seconds(F.when(F.lit(later) & ((n % 7 == 0) | (n % 5 == 0)), 2_000_000_000).otherwise(1_700_000_000) + n % 1000)
    spoilt = F.when(F.lit(later) & (n % 13 == 0), F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    return rows.select("path", F.col("path").alias("file"), F.lit("markdown").alias("kind"), F.lit(".md").alias("extension"), F.length(content).cast("long").alias("size"), stamp.alias("modified"), spoilt.alias("content"))


_SYNCED = ("scanned", "files", "changed", "unchanged", "deleted", "errors", "opened", "possible_legacy_moves")


def catalog_sync(spark, sf):
    folder, scope, rows = workspace(spark, "catalog"), CS.Scope(collections=tuple(COLLECTIONS), buckets=8), []
    for turn, later in enumerate((False, True)):
        files = _files(spark, sf, later)
        done = CS.sync(files.drop("content"), lambda wanted, files=files: files.select("file", "content").join(wanted, "file"), folder, scope)
        rows.append((turn, *(done[c] for c in _SYNCED)))
    return spark.createDataFrame(rows, "sync int, " + ", ".join(f"{c} long" for c in _SYNCED))


def watermarks(spark, sf):
    """The digests that say whether contents, structure, index input or membership have changed."""
    notes = C.with_collections(_notes(spark, sf), COLLECTIONS)
    state = C.identity_state(F.col("id"), F.col("path"))
    known = notes.withColumn("key", CS.identity_key(F.col("id"), F.col("path"))).withColumn("state", state)
    members = C.membership(notes, COLLECTIONS)
    parts = {
        "content": digests.tree_digest(known, "key", "sha256"), "structure": digests.tree_digest(known, "path", "id", "state", "title", "primary_collection"),
        "index_input": digests.tree_digest(known, "path", "sha256"), "members": digests.tree_digest(members, "path", "collection"),
    }
    found = [df.select(F.lit(name).alias("name"), "digest") for name, df in parts.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


def _foci(spark, sf):
    """Notes whose id 50 divides, by path; folders, queries, a collection, and a place that isn't there."""
    named = _notes(spark, sf).where("doc_id % 50 = 0").select(F.concat(F.lit("note"), "doc_id").alias("focus"), F.lit("path").alias("kind"), F.regexp_replace("path", r"\.md$", "").alias("value"))
    more = [("d1", "path", "Sources/en"), ("d2", "path", "Sources/fr/src1"), ("d3", "path", "Nowhere"), ("d4", "path", "Notes"), ("d5", "path", "d42"), ("q1", "query", "doc_12"), ("q2", "query", "s7"), ("c1", "collection", "english")]
    return named.union(spark.createDataFrame(more, "focus string, kind string, value string"))


def context_sections(spark, sf):
    folder, notes = workspace(spark, "context"), _notes(spark, sf)
    found = ledger.shred(_ledgers(spark, sf))
    kept = replace(found, units=written(found.units, f"{folder}/units"), sources=written(found.sources, f"{folder}/sources"))
    return context.sections(_foci(spark, sf), notes, COLLECTIONS, kept, folder)


def route_capsules(spark, sf):
    return context.routes(context_sections(spark, sf), budget=700, least=600)


WIDE = ["doc_12", "ＤＯＣ  7", "Ｄ42", "STRASSE 3", "straße", "ﬁ"]


def _wide_notes(spark, sf):
    """Notes whose titles, aliases and links are written in full width or with letters that only case folding matches."""
    n, wide = F.col("doc_id"), lambda c: F.translate(c, "Do", "Ｄｏ")
    notes = _notes(spark, sf)
    title = F.when(n % 4 == 0, wide(F.col("title"))).otherwise(F.col("title"))
    aliases = F.concat(F.when(n % 4 == 1, F.transform("aliases", wide)).otherwise(F.col("aliases")), F.array(F.concat(F.lit("Straße "), n % 7)))
    links = F.when(n % 4 == 2, F.transform("outlinks", wide)).otherwise(F.col("outlinks"))
    return notes.withColumns({"title": title, "aliases": aliases, "outlinks": links})


def match_tiers_folded(spark, sf):
    return C.find(_wide_notes(spark, sf), WIDE)


def resolve_links_folded(spark, sf):
    return C.resolve_links(_wide_notes(spark, sf))


def _results(spark, sf):
    """Cases by note, and the JSON results of two agents: some left out, some no objects, some with bad evidence."""
    n, path = F.col("doc_id"), F.col("path")
    notes = _notes(spark, sf).select("doc_id", "path")
    agents = F.explode(F.array(F.struct(F.lit("a").alias("agent"), F.lit(1).alias("k")), F.struct(F.lit("b").alias("agent"), F.lit(2).alias("k")))).alias("x")
    rows = notes.select("doc_id", "path", agents).where((F.col("x.k") == 1) | (n % 5 != 0))
    quoted = F.concat(F.lit('"'), path, F.lit('"'))
    status = F.when(n % (F.col("x.k") * 8) == 0, "completed").otherwise("target_required")
    found = F.when(n % 3 == 0, F.concat(quoted, F.lit(', "gone/'), n, F.lit('"'))).otherwise(quoted)
    good = F.concat(F.lit('[{"query": "q", "mode": "exact", "exit_code": 0, "returned_paths": ['), quoted, F.lit("]}]"))
    queries = F.when(n % 6 == 0, '"x"').when(n % 6 == 1, '[{"query": "q", "mode": "fuzzy", "exit_code": 0, "returned_paths": []}, 3]').otherwise(good)
    decisions = F.concat(F.lit('[{"path": '), quoted, F.lit(', "decision": "adopt"'), F.when(n % 7 == 0, "}]").otherwise(', "reason": "r"}]'))
    json = F.concat(
        F.lit('{"status": "'), status, F.lit('", "found_paths": ['), found, F.lit('], "opened_paths": ['), F.when(n % 2 == 0, quoted).otherwise(""), F.lit('], "queries": '), queries,
        F.lit(', "decisions": '), decisions, F.lit("}"),
    )
    results = rows.select("x.agent", n.cast("string").alias("case_id"), F.when(n % 9 == 4, "5").otherwise(json).alias("result"))
    none = F.array().cast("array<string>")
    cases = notes.select(
        n.cast("string").alias("case_id"), F.when(n % 4 == 0, "target_required").alias("expected_status"), F.array(path).alias("must_find"),
        F.when(n % 10 == 0, F.array(path)).otherwise(none).alias("must_not_adopt"), F.when(n % 2 == 0, F.array(F.lit("queries"), F.lit("notes"))).otherwise(none).alias("required_evidence"),
    )
    return evaluation.shred_results(results), cases, notes


def eval_evidence(spark, sf):
    return evaluation.evaluation_failures(*_results(spark, sf), ["a", "b"])


def find_pages(spark, sf):
    return C.find_pages(_notes(spark, sf), [*QUERIES, "no such note"], 20)


def find_pages_exact(spark, sf):
    return C.find_pages(_notes(spark, sf), [*QUERIES, "no such note"], 20, exact=True)


def resolve_targets(spark, sf):
    """Every note by its path in capitals, by its id, or by both, some of which belong to two notes."""
    notes, n = _notes(spark, sf), F.col("doc_id")
    path = F.upper(F.regexp_replace("path", r"\.md$", ""))
    other = F.when(n % 12 == 5, F.concat(F.lit("note_"), F.md5((n + 1).cast("string").cast("binary")))).otherwise(F.nullif("id", F.lit("")))
    asked = notes.select(n.cast("string").alias("asked"), F.when(n % 3 != 0, other).alias("id"), F.when((n % 3 != 1) | other.isNull(), path).alias("path"))
    return C.resolve_targets(notes, asked)


def public_records(spark, sf):
    """Notes with titles of up to 700 characters, up to 19 aliases and up to 29 fields, as answers show them."""
    n = F.col("doc_id")
    many = lambda k: F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= n % k)
    fields = F.map_from_entries(F.transform(many(30), lambda i: F.struct(F.concat(F.lit("F"), F.lpad(i.cast("string"), 2, "0")).alias("k"), F.concat(F.lit("v"), n * i).alias("v"))))
    aliases = F.transform(many(20), lambda i: F.concat(F.lit("a"), i))
    notes = _notes(spark, sf).withColumns({"title": F.concat("title", F.expr("repeat('x', cast(doc_id % 700 as int))")), "aliases": aliases, "metadata": fields})
    found = projections.public_records(C.with_collections(notes, COLLECTIONS))
    joined = {c: F.array_join(F.col(f"{c}.items"), "|") for c in ("aliases", "collections")} | {"metadata": F.array_join(F.map_values("metadata.items"), "|")}
    totals = {f"{c}_total": F.col(f"{c}.total") for c in ("aliases", "metadata")} | {"truncated": F.col("aliases.truncated") | F.col("metadata.truncated")}
    return found.select("path", "id", "identity_state", "identity_key", F.md5(F.col("title").cast("binary")).alias("title_md5"), "primary_collection", *(x.alias(c) for c, x in (totals | joined).items()))


def trace_events(spark, sf):
    """Steps of the event table as events, without what is drawn at random."""
    e = _read(spark, sf, "events")
    steps = e.select(
        F.col("event_id").cast("string").alias("trace_id"), F.lit("run").alias("run_id"), F.concat(F.lit("root"), "user_id").alias("root_span_id"), F.when(F.col("event_id") % 2 == 0, "x").alias("agent"),
        F.concat(F.lit("x:process:"), "user_id").alias("session"), F.lit("rag").alias("component"), F.col("event_type").alias("operation"), F.lit("ok").alias("status"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 3 == 0, "parent").alias("parent_span_id"), F.lit(None).cast("string").alias("target"),
    )
    return projections.events(steps).select("trace_id", "parent_span_id", "agent", "session_key", "operation", F.length("event_id").alias("id_chars"), F.length("span_id").alias("span_chars"), (F.round("duration_ms", 2)).alias("duration"))


def embed_issues(spark, sf):
    """Embeds of the next note, a picture, nothing, and a note that isn't there, with and without other files in the catalog."""
    n = F.col("doc_id")
    notes = _notes(spark, sf).withColumn("embeds", F.array(F.lit("pic.PNG"), F.concat(F.lit("doc_"), n + 1), F.lit(""), F.concat(F.lit("none_"), n, F.lit(".md"))))
    found = [C.embed_issues(notes, other).withColumn("non_markdown", F.lit(other)) for other in (False, True)]
    return found[0].union(found[1])


_NAMES = (
    "tokenize_docs term_freq doc_freq corpus_stats bm25_topk bm25_scoped hash_embed_dims dense_topk_vectors hybrid_topk split_windows"
    " heading_sections extract_links resolve_links backlink_counts match_tiers find_exact find_page resolve_path collection_membership"
    " primary_collection collection_summary child_counts related_collections frontmatter_fields duplicate_ids"
    " ambiguous_names snapshot_diff chunk_audit content_digest ledger_cross_check envelope_routes event_redaction"
    " readme_ancestors identity_totals legacy_moves issue_bag issue_totals event_spans session_supersede pending_events eval_recall eval_jaccard eval_rollup"
    " eval_submissions eval_failures eval_consistency link_counts find_within warning_codes ledger_inputs ledger_outputs"
    " chunk_search chunk_search_scoped index_sync index_audit ledger_documents ledger_sources ledger_units ledger_issues ledger_focus event_redaction_typed catalog_sync watermarks context_sections route_capsules"
    " match_tiers_folded resolve_links_folded eval_evidence find_pages find_pages_exact resolve_targets public_records trace_events embed_issues"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
