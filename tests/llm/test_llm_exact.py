"""Exactness of what only large groups reach: shared pieces, crowded families, gradients, odd pipelines."""

import hashlib
import random

import numpy as np
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_splits_follow_the_pattern():
    regex = pytest.importorskip("regex")
    from scriptorium.llm import op5_bpe as O

    assert O.public_vocabulary()[1] == O.PATTERN
    find, draw = regex.compile(O.PATTERN).findall, random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "日", "٣", "½", "9", "!", "́", "\U0001f600", "_", "'S", "''", " '", "\x85", "​"]
    for _ in range(1500):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(draw.randrange(1, 6))]
        raw, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
        at, counts = O.splits(raw, offs, O.PATTERN)
        want = [find(t) for t in texts]
        assert [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == [p for w in want for p in w] and counts.tolist() == list(map(len, want))


def test_pieces_folded_for_all_tasks(spark):
    tiktoken = pytest.importorskip("tiktoken")
    from scriptorium.llm import op5_bpe as O

    path, pattern = O.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=O.read_ranks(path), special_tokens={})
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("aeioukrst") for _ in range(draw.randrange(3, 12))) for _ in range(300)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).checkpoint()
    assert len(O.share(docs.select("text"), path, pattern, 512, 1000).offs) > 10
    for most, apart in ((0, False), (50, True), (1000, False)):
        for r in O.encode(docs, path, pattern, full=True, most_shared=most, apart=apart).collect():
            assert r.token_ids == library.encode_ordinary(texts[r.doc_id]) and r.decoded == texts[r.doc_id]
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("crowd, percent", [(128, 85), (2, 85), (2, 80)])
def test_large_family_of_near_copies(spark, crowd, percent):
    """Stars from one bad centre; every link between the others must be found again."""
    from scriptorium.llm import op2_minhash as O

    draw = random.Random(crowd + percent)
    base, sets = list(range(1000, 1146)), {}
    for i in range(160):
        extra = list(range(5000, 5040)) if i % 4 == 0 else []  # a branch with a passage of its own
        kept = set(base + extra)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8])):
            at = draw.randrange(len(base) - 5)
            kept -= set(base[at : at + 5])
            kept |= {draw.randrange(10**6, 10**9) for _ in range(5)}
        sets[i] = kept
    part = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    worst = max(sets, key=lambda i: len(sets[i] - set(base)))
    stars = spark.createDataFrame([(i, worst, 1) for i in sets if i != worst], "a long, b long, hits long")
    found = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], "rep long, found binary")
    got = {r.node: r.component for r in O._confirm(stars.checkpoint(), found.checkpoint(), percent, crowd).collect()}
    assert got == part and 1 < len(set(part.values())) < len(part)


def test_components(spark):
    from scriptorium.llm.components import connected_components

    draw = random.Random(3)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1090)] + [(2000, 2000 + i) for i in range(1, 60)] + [(9000, 8000 + i) for i in range(60)]
    part: dict = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((root(a), root(b)))
            part[high] = low
    rows = spark.createDataFrame([*links, (None, 1), (5, None), (7, 7)], "a long, b long").repartition(3)
    assert {r.node: r.component for r in connected_components(rows).collect()} == {x: root(x) for x in list(part)}
    assert connected_components(rows.limit(0)).count() == 0


def test_gradients_are_those_of_the_loss():
    from scriptorium.llm import gru

    draw = np.random.default_rng(0)
    layout = gru.Layout(6, 2, np.array([0, 0, 0, 1, 1, 1, 2, 3]), np.array([0, 1, 2, 0, 1, 2, 0, 0]), np.array([3, 3]), 4, 3)
    par = [p + draw.normal(0, 0.3, p.shape).astype(np.float32) for p in gru.initial(layout, np.zeros(4), np.zeros(6))]
    texts = [draw.integers(0, 8, n).astype(np.int32) for n in (5, 3, 7, 1, 4)]
    window = gru.deal(texts, 0, 2)
    loss = lambda: gru.window_grads(layout, par, np.zeros((2, 4), np.float32), *window)
    first, count, grads, _ = loss()
    assert count == 20 and abs(-first - gru.score(layout, par, texts, 0).sum()) < 1e-3
    for p, g in zip(par, grads):
        spot = tuple(draw.integers(0, n) for n in p.shape)
        p[spot] += 0.01
        up = loss()[0]
        p[spot] -= 0.02
        down = loss()[0]
        p[spot] += 0.01
        assert abs((up - down) / 0.02 - g[spot]) < 1e-2


def test_near_dedup_stage_takes_four_fifths(spark, small):
    """Against brute force over full sets of 5-word shingles."""
    import corpus_pipeline as C

    draw = random.Random(8)
    rows = []
    for group in range(4):
        text = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        for edits in (0, 1, 2, 3, 6):
            copy = list(text)
            for k in range(edits):
                copy[10 + 17 * k] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(116)}
    sets, part = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    found = C.near_dedup(spark, spark.createDataFrame(rows, DOCUMENTS), small)
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(part))


def test_stages_on_odd_rows(spark, small):
    import corpus_pipeline as C

    odd = [(1, None, None, None, 0), (2, "", "en", "s", 0), (None, "some words here", "en", None, 1), (3, "more words", None, "s", 2), (3, "more words", None, "s", 2), (4, "w " * 9000, "en", "t", 3), (5, "12 34", "en", "t", 4)]
    docs = spark.createDataFrame(odd, DOCUMENTS)
    extra = docs.selectExpr("*", "1 as _gone", "2 as row", "'x' as size", "3 as shard", "4 as component_id")
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name
        found = stage(spark, extra, small)
        kept = found.collect()
        if name != "encoding":
            assert found.columns == extra.columns, name
        if name == "language":
            assert {r.doc_id for r in kept} == {None, 3, 4} and len(kept) == 4
        if name in ("near_dedup", "encoding"):
            assert len(kept) == len(odd)
        if name == "mixing":
            assert {r.doc_id for r in kept} <= {None, 3, 4, 5}


def test_mixing_tells_rows_of_one_id_apart(spark):
    from scriptorium.llm.op4_mixing import mix, mixed_documents

    draw = random.Random(2)
    docs = spark.createDataFrame([(i % 40, f"t{i} " + "w " * draw.randrange(1, 90), "en", ["a", "b", None][i % 3], 0) for i in range(120)], DOCUMENTS)
    taken = mix(docs).groupBy().sum("taken").first()[0]
    assert sum(len(r.text.split()) for r in mixed_documents(docs).collect()) == taken


def test_toxicity_fit_equals_plain_arithmetic():
    """The fitted weights against dictionaries of distinct character n-grams."""
    from scriptorium.llm import op10_toxicity as T

    texts, toxic = ["bad zog zog", "zog bad", "fine day", "a fine sun", "zog day"] * 30, [1, 1, 0, 0, 1] * 30

    def grams(text):
        flat = f" {text} "
        return {flat[i : i + n] for n in T.GRAMS for i in range(len(flat) - n + 1)}

    pos, neg = {}, {}
    for text, label in zip(texts, toxic):
        for g in grams(text):
            side = pos if label else neg
            side[g] = side.get(g, 0) + 1
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    ratio = {}
    for g in {*pos, *neg}:
        p, q = pos.get(g, 0) + 1, neg.get(g, 0) + 1
        r = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2))
        if abs(r) / np.sqrt(1 / p + 1 / q) >= 3:
            ratio[g] = r
    names = sorted(ratio)
    x = np.array([[ratio[g] * (g in grams(t)) for g in names] for t in texts])
    w, b, y = np.zeros(len(names)), 0.0, np.array(toxic)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, 301):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = np.append(off @ x / len(y) + 1e-3 * w, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    model = T.fit(texts, toxic)
    got = T.score(model, model.weight != 0, texts)
    assert np.allclose(got, 1 / (1 + np.exp(-(x @ w + b))), atol=1e-3)


def test_folds_open_with_a_look_up(spark):
    from scriptorium.llm import op5_bpe as O

    ranks = O.read_ranks(O.public_vocabulary()[0])
    entries = O.opening(ranks, O.pair_ranks(ranks))
    for a in range(256):
        for b in range(257):
            rank = ranks.get(bytes([a, b]), 1 << 17) if b < 256 else 1 << 17
            assert entries[a * 257 + b] == rank << 17 | ranks[bytes([a])]
    words = spark.createDataFrame([([[0], [255, 255], [32, 97, 116], [195, 169] * 40],)], "words array<array<smallint>>")
    found = O._fold(words, ranks, [])
    assert found.first().tokens == [O.merge_long(bytes(w), ranks) for w in words.first().words]
    assert "opening" in found._jdf.queryExecution().optimizedPlan().toString()


def test_pipeline_shares_as_many_pieces_as_the_operator(monkeypatch, spark, small):
    import inspect

    import corpus_pipeline
    from scriptorium.llm import op5_bpe as O

    given = {}
    monkeypatch.setattr(corpus_pipeline, "encode", lambda *a, **b: given.update(b))
    corpus_pipeline.encoding(spark, None, small)
    assert given.get("most_shared", 1 << 19) >= inspect.signature(O.encode).parameters["most_shared"].default
