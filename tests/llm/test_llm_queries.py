"""The registered queries against their SQL, and the pipeline against its operators."""

import hashlib
import itertools
import random
import re
from collections import Counter

import compare
import pytest
from pyspark.sql import functions as F

queries = pytest.importorskip("scriptorium.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, small, duck, name):
    found = queries.queries()[name](spark, small)
    assert compare.differences(found, duck, queries.oracle_sql()[name]) == ""


def test_thirteen_queries():
    assert [int(q[2:].split("_")[0]) for q in queries.queries()] == list(range(1, 14))


def test_pipeline(spark, small):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    clean = C.toxicity(spark, docs, small)
    assert clean.columns == docs.columns and clean.count() >= 0.8 * docs.count()
    assert len(toxic - {r.doc_id for r in clean.collect()}) >= len(toxic) / 2
    blank = spark.createDataFrame([(1, "12 34", None, None, 5), (2, None, "en", "s", 0), (3, "words here", "en", "s", 10), (None, "more words", "en", "s", 10)], docs.schema)
    assert {r.doc_id for r in C.language(spark, blank, small).collect()} == {3, None}
    kept = C.near_dedup(spark, docs, small)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == representatives([(r.doc_id, r.text) for r in docs.collect()], 80)
    out = C.run(spark, small)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def representatives(rows, percent):
    """The smallest id of each component, by comparing all pairs of sets; texts without a word stand alone."""
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    part = {d: d for d in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            part[high] = low
    return sorted({root(x) for x in sets})


def test_language_stage_decides_by_phrases(spark, small):
    import corpus_pipeline as C
    from scriptorium.llm import op7_langid as O

    docs = spark.read.parquet(f"{small}/documents.parquet")
    draw = random.Random(2)
    junk = [" ".join("".join(draw.choice("bcdfghjkqvwxz") for _ in range(draw.randrange(2, 9))) for _ in range(80)), "чужой язык без обучения " * 9]
    more = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate([*junk, "12 34", "brief note"])]
    kept = {r.doc_id for r in C.language(spark, docs.union(spark.createDataFrame(more, docs.schema)), small).collect()}
    clean = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").collect()}
    assert kept == clean | {10**6 + 3}
    # the phrases that decide are those of a search in the training text itself
    model = O.fit({"x": ["ab cab dab abc"], "y": ["zzyx"]}, 100)
    assert O.parsed(model, ["abcab"])[0][2:] == (5, 2) and O.fits(model, ["q" * 40, "ab" * 3]) == [False, True]


def test_pipeline_rows_equal_a_plain_chain(spark, small):
    """Every stage's rows against plain Python over the rows before it; ``run`` gives the last ones."""
    import corpus_pipeline as C
    import tiktoken
    from scriptorium.llm import op4_mixing as M
    from scriptorium.llm import op5_bpe as B
    from scriptorium.llm import op7_langid as L
    from scriptorium.llm import op10_toxicity as X

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    stages = {name: stage for name, stage in C.STAGES}
    assert list(stages) == ["toxicity", "language", "near_dedup", "mixing", "encoding"]
    toxic = X.train(docs, labels, "doc_id", "text", "toxic", F.lit(True), train_docs=2000, train_chars=20_000_000)
    scored = docs.select("*", X.toxicity_column(toxic, docs)(F.col("text")).alias("p")).collect()
    after = {"toxicity": Counter(tuple(r)[:-1] for r in scored if r.p < 0.5)}
    previous = stages["toxicity"](spark, docs, small)
    assert rows(previous) == after["toxicity"]
    model = L.train(previous, "text", "lang", train_texts=64, train_chars=24_000)
    want = Counter({r: n for r, n in after["toxicity"].items() if L.fits(model, [r[1] or ""])[0]})
    previous = stages["language"](spark, previous, small)
    assert rows(previous) == want
    kept = set(representatives([r[:2] for r in want], 80))
    previous = stages["near_dedup"](spark, previous, small)
    assert rows(previous) == Counter({r: n for r, n in want.items() if r[0] in kept})
    before, mixed = {r.doc_id: r for r in previous.collect()}, stages["mixing"](spark, previous, small).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    taken = Counter()
    for r in mixed:
        whole = before[r.doc_id]
        assert (r.lang, r.source, r.n_chars) == (whole.lang, whole.source, whole.n_chars)
        assert r.text == whole.text or (r.text == " ".join(words(whole.text)[: len(words(r.text))]))
        taken[r.source] += len(words(r.text))
    sizes = Counter()
    for r in before.values():
        sizes[r.source] += len(words(r.text))
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    goals = M.targets([sizes[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert [taken[x] for x in names] == [min(round(g), 2 * sizes[x]) for x, g in zip(names, goals)]
    path, pattern = B.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(path), special_tokens={})
    last = Counter()
    for r in mixed:
        ids = library.encode_ordinary(r.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        last[r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert rows(C.run(spark, small)) == last
