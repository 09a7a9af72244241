"""Each operator on small fixtures, against brute force where SQL can't say it."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, size int, shard string, score string"


def docs(spark, rows):
    """Rows (id, text[, lang, source]) with extra columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 7, "x", "y") for r in rows]
    return spark.createDataFrame(full, DOC)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "b c d e f"), (5, "w " * 20000), (6, "Ünï cødé 日本 \U0001f600"), (7, "0 1 2")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


# --- op1 -----------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, size int, first long")


def test_warc(spark, tmp_path):
    from scriptorium.llm import op1_warc as O

    long = "<p>é" * 400
    rows = [(1, "u", long, 0, 0), (3, "u3", long, 0, 0), (3, "u3", long, 0, 0), (None, None, long, 0, 0), (4, "x\r\ny", None, 0, 0), (5, "z", "short", 0, 0), (6, "z", "short", 0, 0), (7, "q", "x" * 1000, 0, 0)]
    found = {}
    for r in O.archive(pages(spark, rows), f"file://{tmp_path}/w").collect():
        found.setdefault(r.page_id, []).append(r)
    sha = hashlib.sha1(long.encode()).hexdigest()
    assert [(r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found[1]] == [("revisit", 3, len(long.encode()), sha)]
    assert [r.record_type for r in found[3]] == ["response"] * 2
    assert found[None][0].refers_to == 3 and found[4][0].payload_bytes == 0
    assert found[5][0].record_type == found[6][0].record_type == "response"
    assert O.archive(pages(spark, [])).count() == 0
    first = next(iter(sorted(tmp_path.glob("w/*.warc.zst")))).read_bytes()
    assert int.from_bytes(first[:4], "little") == O.SKIPPABLE
    size = int.from_bytes(first[4:8], "little")
    assert first[8 + size : 12 + size] == O.FRAME  # each record is a frame of its own
    assert len(list(O.frames(first))) == first.count(O.FRAME)


def test_warc_dictionary():
    from scriptorium.llm import op1_warc as O

    assert O.train([], 1000) == b"" and O.train([b"abc"], 1000) == b"abc"
    assert len(O.train([f"<html>{i} common words in every page {i * 7}</html>".encode() * 3 for i in range(500)], 4096)) > 8


# --- op2 -----------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    part = {r[0]: r[0] for r in rows}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = root(rows[i][0]), root(rows[j][0])
                part[max(x, y)] = min(x, y)
    return {r[0]: (len(s), root(r[0])) for r, s in zip(rows, sets)}


@pytest.mark.parametrize("hot", [64, 2])
def test_near_duplicates(spark, hot):
    from scriptorium.llm.op2_minhash import near_duplicates

    draw = random.Random(4)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "one")]
    for base in range(6):
        text = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([40, 120, 400]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(draw.randrange(0, max(2, len(text) // 40))):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    draw.shuffle(rows)
    want = brute_components(rows)
    found = near_duplicates(docs(spark, rows), hot=hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("slices, shift, seed", [([[2, 3], [1], [4]], 8, None), (None, 6, 1)])
def test_links_to_members_hidden_in_a_slice(spark, slices, shift, seed):
    """One bucket dealt over several slices; every pair of it is held against brute force."""
    from scriptorium.llm import op2_minhash as O

    sets = {i: set(range(i * shift, i * shift + 100)) for i in range(1, 5)}
    if slices is None:
        draw = random.Random(seed)
        order = draw.sample(range(1, 41), 40)
        at = {i: draw.randrange(45) * shift for i in order}
        sets = {i: set(range(at[i], at[i] + 100)) for i in order}
        slices = [order[k : k + 5] for k in range(0, 35, 5)] + [[i] for i in order[35:]]
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (200 - both):
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    half = np.arange(2, dtype=np.uint64).tobytes()
    dealt = spark.sparkContext.parallelize(slices, len(slices)).flatMap(lambda ids: [(i, bytearray(half)) for i in ids])
    stars = O._stars(O._bucket_rows(spark.createDataFrame(dealt, "rep long, halves binary"), 1, 2))
    found = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], "rep long, found binary")
    got = {r.node: r.component for r in O._confirm(stars.checkpoint(), found.checkpoint(), 85).collect()}
    assert {i: got.get(i, i) for i in sets} == part


def test_near_duplicates_odd_rows(spark):
    from scriptorium.llm.op2_minhash import drop_near_duplicates, near_duplicates

    found = near_duplicates(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i) for i, _ in ODD}
    assert near_duplicates(docs(spark, [])).count() == 0
    kept = drop_near_duplicates(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f")]))
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == DOC.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


# --- op3 -----------------------------------------------------------------


def test_shards(spark):
    from scriptorium.llm.op3_shards import balanced_shards

    found = balanced_shards(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    for r in found:
        texts = {(t or "").encode() for i, t in ODD if i == r.doc_id}
        assert any(r["size"] == len(t) + 1 and r.text_crc32 == zlib.crc32(t) for t in texts)
    many = balanced_shards(docs(spark, [(i, "x" * (i % 13)) for i in range(500)])).collect()
    total = sum(r["size"] for r in many)
    for s in range(16):
        own = sorted((r for r in many if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [r.doc_id for r in own] == sorted(r.doc_id for r in own)
        assert abs(sum(r["size"] for r in own) - total / 16) <= 14
    assert balanced_shards(docs(spark, [])).count() == 0


# --- op4 -----------------------------------------------------------------


def test_targets():
    from scriptorium.llm.op4_mixing import split_quotas, targets

    sizes = [100, 1000, 0, 50]
    found = targets(sizes, [5, 2, 1, 5])
    assert abs(sum(found) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes))
    parts = split_quotas([10, 0, 333, 7], 16)
    assert parts.sum(axis=0).tolist() == [10, 0, 333, 7] and np.ptp(parts.sum(axis=1)) <= 1
    assert (parts == split_quotas([10, 0, 333, 7], 16)).all()


def test_mix(spark):
    from scriptorium.llm.op4_mixing import mix, mixed_documents

    draw = random.Random(1)
    rows = [(i, " ".join("w" * draw.randrange(1, 30)) if i % 9 else None, "en", [None, "a", "b", "c"][i % 4]) for i in range(300)]
    frame = docs(spark, rows)
    found = mix(frame, block_rows=5).collect()
    again = mix(frame, block_rows=5).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)
    for source in (None, "a", "b", "c"):
        own = [r for r in found if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].source_size == sum(r["size"] for r in own)
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
    out = mixed_documents(frame, block_rows=5)
    assert out.columns == frame.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {r.doc_id: r.taken for r in found if r.taken}
    assert mix(docs(spark, ODD)).count() == len(ODD)
    assert mix(docs(spark, [])).count() == 0 and mixed_documents(docs(spark, [])).count() == 0


# --- op5 -----------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    from scriptorium.llm import op5_bpe as O

    path, pattern = O.public_vocabulary()
    ranks = O.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(0)
    texts = ["".join(draw.choice("abcdé  \n\t'strLL19.!€日ßÜ \U0001f600") for _ in range(draw.randrange(80))) for _ in range(60)]
    texts += [None, "", "a" * 3000, " " * 50 + "x", "<|endoftext|>", "thionreou " * 50]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "null id")]
    for options in ({}, {"flush_bytes": 200, "most_words": 50, "fold_most": 20}):
        found = O.encode(docs(spark, rows), path, pattern, full=True, **options).collect()
        assert len(found) == len(rows)
        for r in found:
            text = "null id" if r.doc_id is None else texts[r.doc_id] or ""
            ids = library.encode_ordinary(text)
            assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == text
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert O.encode(docs(spark, []), path, pattern).count() == 0


def test_rank_map():
    from scriptorium.llm import op5_bpe as O

    draw = random.Random(2)
    pairs = {(draw.randrange(50000), draw.randrange(50000)): i for i in range(5000)}
    first, second = O.rank_map(pairs)
    look = lambda k: min(int(first[k % len(first)]) ^ k << 17, int(second[k % len(second)]) ^ k << 17)
    assert all(look(a << 17 | b) == r for (a, b), r in pairs.items())
    assert all(look(a << 17 | b) >= 1 << 17 for a in range(50) for b in range(50) if (a, b) not in pairs)


# --- op6 -----------------------------------------------------------------


def test_top_k(spark):
    from scriptorium.llm.op6_topk import top_k

    draw = np.random.default_rng(0)
    rows = [(i, [float(x) for x in draw.integers(-3, 3, 4)], 1, 2) for i in range(230)]
    rows += [(300, None, 0, 0), (301, [1.0, None, 0.0, 0.0], 0, 0), (302, [float("nan")] * 4, 0, 0), (303, [float("inf"), 0.0, 0.0, 0.0], 0, 0), (350, [1.0, 2.0], 0, 0), (351, [3.0, 1.0], 0, 0), (None, [1.0] * 4, 0, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int")
    want = []
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for options in ({}, {"block_queries": 2, "merge_groups": 2}):
        found = top_k(frame.repartition(3), F.col("vec_id") % 50 == 0, **options)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert top_k(frame.limit(0), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.score) for r in top_k(two, F.lit(True)).collect()} == {(0, 2**63 - 1), (1, 2**63 - 1)}


# --- op7 -----------------------------------------------------------------


def test_phrases_are_longest_matches():
    from scriptorium.llm import op7_langid as L

    draw = random.Random(3)
    train = {"x": ["".join(draw.choice("abc ") for _ in range(300))], "y": ["".join(draw.choice("abd ") for _ in range(300))]}
    model = L.fit(train, 1000)
    texts = ["".join(draw.choice("abcd e") for _ in range(n)) for n in [1, 5, 200, 40, *range(3, 70)]]
    found = L.phrases(model, L._sequences(model, texts))
    for text, counts in zip(texts, found):
        clean = "".join(c if c.isalpha() else " " for c in text)
        clean = re.sub(" +", " ", clean).lstrip()  # a leading blank is dropped
        for language, got in zip(model.languages, counts):
            corpus = (" " + L.simplify(train[language][0]) + " ")[:1000]
            match, n = "", 1
            for c in clean:  # a phrase ends where the match can't grow
                if match + c in corpus:
                    match += c
                else:
                    match, n = c if c in corpus else "", n + 1
            assert n == got


def test_language(spark, small):
    from scriptorium.llm.op7_langid import held_out, identify

    frame = spark.read.parquet(f"{small}/documents.parquet")
    held = held_out("doc_id", 4, 2)
    found = identify(frame, ~held).join(frame.select("doc_id", "lang", held.alias("held")), "doc_id").where("held").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) and all(0 <= r.score <= 1 for r in found)
    odd = identify(docs(spark, ODD), F.lit(True)).collect()
    assert len(odd) == len(ODD) and {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 7}
    untaught = identify(docs(spark, [(1, "some text", None)]), F.lit(True)).first()
    assert untaught.lang_pred == "und" and identify(docs(spark, []), F.lit(True)).count() == 0


def test_every_language_and_letter_is_learnt(spark):
    from scriptorium.llm import op7_langid as L

    draw = random.Random(6)
    rows = []
    for i in range(70):
        letters = [chr(0x4E00 + 8 * i + k) for k in range(8)]
        vocabulary = ["".join(draw.choice(letters) for _ in range(3)) for _ in range(9)]
        rows += [(len(rows) + k, " ".join(draw.choice(vocabulary) for _ in range(40)), f"l{i:02}") for k in range(3)]
    found = L.identify(docs(spark, rows), F.col("doc_id") % 3 > 0).collect()
    assert {(r.doc_id, r.lang_pred) for r in found} == {(i, lang) for i, _, lang in rows}
    long = L.fit({"x": ["a" * 30000, "b c"]}, 24000)  # one long text leaves room for the others
    assert long.lengths[0] == 24000 and long.symbols[ord("b")] > 1


# --- op8 -----------------------------------------------------------------


def test_fingerprints(spark, small):
    from scriptorium.llm.op8_fingerprints import edited_fingerprints, fingerprints

    def gap(frame, rows, tolerance):
        def sets(t):
            w = words(t)
            return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

        alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        found = {r.doc_id: r for r in edited_fingerprints(frame, bucket_rows=16).collect()}
        assert len(found) == len(rows)
        order = sorted(rows, key=lambda r: -r[0])
        for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
            text, after, r = text or "", after or "", found[i]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(r.near_edited - alike(sets(text), sets(edited))) < tolerance
            assert abs(r.near_next - alike(sets(text), sets(after))) < tolerance
        return found

    frame = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    found = gap(frame, rows, 0.2)
    same = {}
    for i, text in rows:
        same.setdefault(text, set()).add(found[i].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    gap(docs(spark, [(5, "a b c d e f g"), (9, None), (2, "\U0001f600é" * 9), (7, "")]), [(5, "a b c d e f g"), (9, None), (2, "\U0001f600é" * 9), (7, "")], 0.25)
    assert edited_fingerprints(docs(spark, ODD)).count() == len(ODD)
    assert edited_fingerprints(docs(spark, [])).count() == 0
    alone = edited_fingerprints(docs(spark, [(1, "one two three four five six")])).first()
    assert alone.near_next == 1.0 and len(alone.fingerprint) == 512
    assert fingerprints(docs(spark, ODD)).where("fingerprint = ''").count() == 3


# --- op9 -----------------------------------------------------------------


def test_gru_lanes_equal_single_texts():
    from scriptorium.llm import gru

    draw = np.random.default_rng(1)
    layout = gru.Layout(6, 2, np.array([0, 0, 0, 1, 1, 1, 2, 3]), np.array([0, 1, 2, 0, 1, 2, 0, 0]), np.array([3, 3]), 4, 3)
    par = [p + draw.normal(0, 0.3, p.shape).astype(np.float32) for p in gru.initial(layout, np.zeros(4), np.zeros(6))]
    texts = [draw.integers(0, 8, n).astype(np.int32) for n in (0, 1, 40, 7, 100)]
    together = gru.score(layout, par, texts, 0, window=5)
    alone = [gru.score(layout, par, [t], 0, window=17)[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-3)
    one_step = sum(np.exp(gru.score(layout, par, [np.array([k], np.int32)], 0)[0]) for k in range(8))
    assert abs(one_step - 1) < 1e-4  # a distribution over tokens and rare classes


def test_scoring(spark, small):
    from scriptorium.llm.op7_langid import held_out
    from scriptorium.llm.op9_lm import score_documents

    frame = spark.read.parquet(f"{small}/documents.parquet")
    held = held_out("doc_id", 5, 1)
    found = score_documents(frame, ~held, known_most=300).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in frame.collect()}
    learnt = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    count, ends = {}, len(learnt)
    for w in learnt:
        for t in w:
            count[t] = count.get(t, 0) + 1
    total, distinct = sum(count.values()) + ends, len(count) + 1
    for r in found:
        w = texts[r.doc_id]
        base = sum(np.log10(count.get(t, 0) + 0.5) for t in w) + np.log10(ends + 0.5) - (len(w) + 1) * np.log10(total + 0.5 * (distinct + 1))
        assert abs(base - r.base_score) < 1e-6 and r.n_known == sum(t in count for t in w) + 1 and r.train_tokens == total
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    odd = score_documents(docs(spark, ODD), F.lit(True)).collect()
    assert len(odd) == len(ODD) and {r.n_tokens for r in odd if r.doc_id in (1, 2, 3)} == {1}
    assert score_documents(docs(spark, []), F.lit(True)).count() == 0
    blank = score_documents(docs(spark, [(1, "a b")]), F.lit(False)).first()
    assert blank.n_known == 0 and blank.train_tokens == 0 and abs(blank.base_score) < 1e-9


def test_every_document_trains_the_model(spark):
    from scriptorium.llm.op9_lm import score_documents

    for i in (1, 2):  # without training the score of a lone document is the base
        lone = score_documents(docs(spark, [(i, "one two three four " * 400)]), F.lit(True)).first()
        assert lone.score - lone.base_score > 0.01 * abs(lone.base_score), (lone.score, lone.base_score)


# --- op10 ----------------------------------------------------------------


def test_toxicity(spark, small):
    from scriptorium.llm.op10_toxicity import score_toxicity

    draw = random.Random(0)
    clean = lambda: " ".join("".join(draw.choice("aeioulnrst") for _ in range(6)) for _ in range(60))
    rows = [(i, clean() + (" you vile grozbak fool " if i % 4 == 0 else " ") + clean()) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    found = score_toxicity(docs(spark, rows), labels, F.col("doc_id") % 5 != 0).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) and 0 <= r.score <= 1 for r in found)
    odd = score_toxicity(docs(spark, ODD), labels, F.lit(True)).collect()
    assert len(odd) == len(ODD)
    assert score_toxicity(docs(spark, []), labels, F.lit(True)).count() == 0
    assert score_toxicity(docs(spark, ODD), labels.limit(0), F.lit(True)).agg(F.max("score")).first()[0] < 1e-9


def test_every_labelled_text_sets_the_limit(spark, monkeypatch):
    from scriptorium.llm import op7_langid as L

    draw, learnt, fit = random.Random(4), [], L.fit
    word = lambda odd: "".join(draw.choices("qxzjkvw" if odd else "aeinrst", k=5))
    texts = [" ".join(word(i % 5 == 0) for _ in range(20 + i % 7)) for i in range(150)]
    monkeypatch.setattr(L, "fit", lambda samples, most: learnt.extend(x for t in samples.values() for x in t) or fit(samples, most))
    frame = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    model = L.train(frame, "text", "lang", train_texts=2, train_chars=10_000)
    assert len(learnt) == 2
    rates = sorted(n / size for _, _, size, n in L.parsed(model, [t for t in texts if t not in learnt]))
    want = 2 * rates[-(-95 * len(rates) // 100) - 1]
    assert len(rates) == 148 and want <= model.limit <= want + 3e-4


def test_near_duplicates_in_turns(spark):
    from scriptorium.llm.op2_minhash import near_duplicates

    draw = random.Random(8)
    base = [[f"w{draw.randrange(3000)}" for _ in range(90)] for _ in range(6)]
    rows = [(i, " ".join(w if draw.random() > 0.004 else "new" for w in base[i % 6])) for i in range(60)]
    found = [sorted(map(tuple, near_duplicates(docs(spark, rows), turns=n).collect())) for n in (1, 3, 10)]
    assert found[0] == found[1] == found[2] and len({r[2] for r in found[0]}) < 60


def test_near_duplicates_turns_follow_the_size(spark, monkeypatch):
    """A small table isn't dealt in turns, each of which costs a dozen shuffles; a large one is, with the same result."""
    from scriptorium.llm import op2_minhash as O

    draw, seen, deal = random.Random(9), [], O._in_turns
    monkeypatch.setattr(O, "_in_turns", lambda make, turns, spark: seen.append(turns) or deal(make, turns, spark))
    base = [f"w{draw.randrange(3000)}" for _ in range(90)]
    rows = [(i, " ".join(w if draw.random() > 0.01 else f"new{i}" for w in base)) for i in range(1, 20)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in O.near_duplicates(docs(spark, rows)).collect()}
    assert found == brute_components(rows) and set(seen) == {1}
    assert [O._turns(n, 10) for n in (0, 10, 11, 50, 10**9)] == [1, 1, 2, 5, 5]


def test_gru_windows_lengthen_with_few_texts(monkeypatch):
    """A lone long text is scored in windows as long as many texts' windows are wide; the scores are those of one step at a time."""
    from scriptorium.llm import gru

    draw = np.random.default_rng(6)
    layout = gru.Layout(6, 2, np.array([0, 0, 0, 1, 1, 2, 3, 4]), np.array([0, 1, 2, 0, 1, 0, 0, 0]), np.array([3, 2, 1]))
    par = [draw.normal(0, 0.4, shape).astype(np.float32) for shape in layout.shapes()]
    texts = [draw.integers(0, 8, n).astype(np.int32) for n in (4000, 1, 0, 30)]
    calls, output = [], gru.output_log
    monkeypatch.setattr(gru, "output_log", lambda layout, par, states, *rest: calls.append(len(states)) or output(layout, par, states, *rest))
    found = gru.score(layout, par, texts, 0)
    assert len(calls) == 1 and sum(calls) == 4031
    singly = gru.score(layout, par, texts, 0, window=1, most=1)
    assert np.allclose(found, singly, rtol=1e-5) and len(calls) > 4000


def test_scoring_in_lots(spark):
    """However many batches are scored side by side, each row keeps its own score."""
    from scriptorium.llm.op9_lm import score_documents

    draw = random.Random(11)
    rows = [(None if i == 7 else i, " ".join(draw.choice(["ab", "cde", "f", "ghi", f"x{i}"]) for _ in range(draw.randrange(40)))) for i in range(40)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        found = [{r.doc_id: r for r in score_documents(docs(spark, rows), F.lit(True), lot_tokens=n).collect()} for n in (1, 10**6)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(found[0]) == len(found[1]) == 40
    for i, text in rows:
        one, other = found[0][i], found[1][i]
        assert one.n_tokens == other.n_tokens == len(text.split()) + 1 and one.n_known == other.n_known
        assert abs(one.score - other.score) < 1e-4 and one.base_score == other.base_score


def test_gru_windows_use_memory_anew():
    """Windows of other sizes, outputs that must be shifted and earlier contents change no gradient; a window takes little new memory."""
    import tracemalloc

    from scriptorium.llm import gru

    draw = np.random.default_rng(12)
    layout = gru.Layout(6, 2, np.array([0, 0, 0, 1, 1, 2, 3, 4]), np.array([0, 1, 2, 0, 1, 0, 0, 0]), np.array([3, 2, 1]))
    par = [draw.normal(0, 0.4, shape).astype(np.float32) for shape in layout.shapes()]
    wide = [p + np.float32(200) * (i == 5) for i, p in enumerate(par)]  # exp of these outputs is infinite unless shifted
    room = gru.Room()
    for own, steps, width, share in ((par, 24, 160, 1.0), (par, 5, 7, 0.6), (wide, 24, 160, 0.9), (par, 24, 160, 1.0)):
        inputs, targets = (draw.integers(0, 8, (steps, width)).astype(np.int32) for _ in range(2))
        state = draw.normal(0, 0.5, (width, layout.hidden)).astype(np.float32)
        window = (state, inputs, targets, draw.random((steps, width)) < 0.1, draw.random((steps, width)) < share)
        fresh = gru.window_grads(layout, own, *window)
        tracemalloc.start()
        found = gru.window_grads(layout, own, *window, room)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found[:2] == fresh[:2] and np.array_equal(found[3], fresh[3]) and np.isfinite(found[0])
        assert all(np.array_equal(a, b) and np.isfinite(a).all() for a, b in zip(found[2], fresh[2]))
    assert most < 24 * 160 * layout.hidden * 4 * 4, most  # the gates and slopes alone take nine such arrays


def test_scoring_reads_texts_twice(spark):
    """Once to count words and once to write tokens, however many rounds learn from them."""
    from scriptorium.llm.op9_lm import score_documents

    draw = random.Random(13)
    rows = [(i, " ".join(draw.choice(["ab", "cde", "f", f"x{i}"]) for _ in range(draw.randrange(40)))) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    counted = docs(spark, rows).withColumn("text", F.udf(count)("text"))
    found = score_documents(counted, F.col("doc_id") % 3 != 0, group_docs=10).collect()
    assert len(found) == 60 and seen.value <= 120, seen.value


def test_tokens_are_those_of_each_text(spark):
    """Rows of several batches, null and empty texts, and words that the tasks' table doesn't hold."""
    from scriptorium.llm import op9_lm as L

    draw = random.Random(14)
    rows = [(1, None), (2, ""), (3, " \n "), *((i, " ".join(draw.choice(["Ab", "cde", "f", f"x{i}"]) for _ in range(i))) for i in range(4, 40))]
    frame = docs(spark, rows).select("doc_id", F.lit(True).alias("learnt"), F.col("doc_id").alias("spot"), "text")
    counts = L.word_counts(frame, "text").cache()
    count = {}
    for _, text in rows:
        for w in (text or "").lower().split():
            count[w] = count.get(w, 0) + 1
    lex = L.lexicon(counts, len(rows), 2, 2, 3)
    found = {r.doc_id: r for r in L.encode(frame, spark.sparkContext.broadcast(lex)).collect()}
    assert set(found) == {i for i, _ in rows}
    known = sorted(count, key=count.get)[-3:]
    for i, text in rows:
        own, words = found[i], (text or "").lower().split()
        codes = np.frombuffer(own.tokens, L._code(lex.layout))
        assert own.n_tokens == len(codes) == len(words) + 1 and codes[-1] == lex.end_input
        assert own.n_known == sum(w in known for w in words) + 1 and sum(own.counts) == sum(w not in known for w in words)
        assert abs(own.base - sum(np.log10(count[w] + 0.5) for w in words if w in known) - np.log10(len(rows) + 0.5)) < 1e-9
        head = [int(c) for c, w in zip(codes, words) if w in known[-2:]]
        assert all(c < lex.layout.head for c in head) and sum(c < lex.layout.head for c in codes) == len(head) + 1
