"""Packing, fill-in-the-middle and spelling variants on small fixtures, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

DOC = "doc_id long, text string, lang string, n int, form string, word string, part long"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "b c d e f"), (5, "w " * 20000), (6, "Ünï cødé 日本 \U0001f600 <|endoftext|>"), (7, "x" * 30000)]


def docs(spark, rows):
    """Rows (id, text) with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "en", 7, "x", "y", 3) for r in rows], DOC)


# --- op11 ----------------------------------------------------------------


def packed(spark, rows, **options):
    """(pieces, their ids by sequence) of ``rows``, after what must hold for every packing."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from scriptorium.llm import op11_packing as O

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    length = options.get("length", 1024)
    source = docs(spark, rows).repartition(options.pop("parts", 1))
    found = O.pack(source, O.public_vocabulary(), full=True, **options).collect()
    want = Counter()
    for doc, text in rows:
        want[doc, tuple([*known.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    sequences, by_doc = {}, {}
    for p in found:
        assert len(p.token_ids) == p.length > 0
        assert zlib.crc32(np.array(p.token_ids, "<u4").tobytes()) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        sizes = [p.length for p in pieces]
        assert [p.offset for p in pieces] == [sum(sizes[:i]) for i in range(len(sizes))]
        total = sum(sizes)
        assert total <= length
        if total & (total - 1):
            assert length - total <= options.get("most_padding", 4)
            padding += length - total
    for (doc, total), pieces in by_doc.items():  # every id of every document once
        spans = Counter()
        for p in pieces:
            spans.update(range(p.start, p.start + p.length))
        times = {x for x in spans.values()}
        assert set(spans) == set(range(total)) and len(times) == 1
        texts = [t for (d, t), n in want.items() for _ in range(n) if d == doc and len(t) == total]
        assert len(texts) == times.pop()
        at = {(p.start, p.length): p.token_ids for p in pieces}
        if len({*texts}) == 1:
            assert all(list(texts[0][s : s + n]) == ids for (s, n), ids in at.items())
    assert sum(len(t) * n for (_, t), n in want.items()) == sum(p.length for p in found)
    return found, padding


def test_packing_odd_rows(spark):
    packed(spark, ODD, parts=3)
    assert packed(spark, [])[0] == []
    assert [tuple(p)[:3] for p in packed(spark, [(1, None)])[0]] == [(1, 0, 1)]


def test_packing_many_tasks(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "gam", "d"]) for _ in range(draw.choice([1, 3, 9, 40, 200])))) for i in range(400)]
    found, padding = packed(spark, rows, parts=11, length=64, open_windows=4, fan=2, most_padding=1)
    assert padding <= sum(p.length for p in found) / 64
    whole = [p for p in found if p.doc_tokens <= 64 and p.length == p.doc_tokens]
    assert len(whole) > 0.5 * len({p.doc_id for p in found if p.doc_tokens <= 64})


def test_packer_places_best_fit():
    from scriptorium.llm.op11_packing import Packer

    packer = Packer(10, 2, 1)
    ids = lambda n: np.zeros(n, np.uint32)
    for doc, n in enumerate((4, 7, 3, 5)):  # rooms 6 and 3; three fills the second exactly, five goes to the first
        packer.document(doc, ids(n))
    assert [[p[0] for p in s] for s in packer.done] == [[1, 2]]
    assert [[p[0] for p in s] for s in packer.open.values()] == [[0, 3]]
    packer.document(4, ids(8))
    packer.document(5, ids(7))  # fits nowhere: the fullest has one place left and goes as it is
    assert [[p[0] for p in s] for s in packer.done][1:] == [[0, 3]]
    packer.document(6, ids(9))  # fits nowhere: the fullest is filled with its first two, the rest opens a new one
    assert [[(p[0], p[1], len(p[3])) for p in s] for s in packer.done][2:] == [[(4, 0, 8), (6, 0, 2)]]
    packer.pour()
    assert [sum(len(p[3]) for p in s) for s in packer.done][3:] == [10, 4]


# --- op12 ----------------------------------------------------------------


def fim_by_hand(doc, text):
    text = text or ""
    h = [int(x, 16) for x in re.findall("........", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest())[:4]]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_fill_in_middle(spark):
    from scriptorium.llm import op12_fim as O

    rows = [*ODD, *((i, "<" * (i % 5) + "S>P>M>" * (i % 3) + f"text {i}\n\r<") for i in range(10, 200)), (300, "a<P>b"), (301, "<M>"), (302, "<S"), (2**60 + 1, "long id")]
    found = O.fill_in_middle(docs(spark, rows))
    out = found.select("*", O.restored("output", "form").alias("text"), O.sha256("output").alias("sha")).collect()
    want = Counter((doc, *fim_by_hand(doc, text), text or "") for doc, text in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert all(r.sha == hashlib.sha256(r.output.encode()).hexdigest() for r in out)
    assert O.fill_in_middle(docs(spark, [])).count() == 0


def test_units_and_rebuilding():
    from scriptorium.llm import op12_fim as O

    assert list(O.unit_ends("ab\U0001f600\n", O.CODE_POINT)) == [1, 2, 3, 4] and list(O.unit_ends("", O.CODE_POINT)) == []
    assert list(O.unit_ends("one two  three", r"\w+\s*")) == [4, 9, 14]
    for key in range(300):
        text = ["<S", "<P<M", "x<", "><S", "a b c"][key % 5] * (key % 4 + 1)
        n, form, prefix, middle, output = O.cut(text, str(key), r"\w+|.", 3, 100, 50)
        assert O.rebuilt(output, form) == text and (form == "plain") == any(m in text for m in ("<P>", "<S>", "<M>"))


# --- op13 ----------------------------------------------------------------


def runs_by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return counts


def near(a, b):
    """One inserted, deleted or replaced code point, by trying every place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_by_hand(words, times=5):
    out, form = {}, {}
    for w, n in words.items():
        met = [x for x in words if near(w, x)]
        best = min(met, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        out[w] = len(met)
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], out[w], words[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("most_chars,shard_chars", [(4_000_000, 2_000_000), (60, 200)])
def test_spelling_against_brute_force(spark, most_chars, shard_chars):
    from scriptorium.llm import op13_spelling as O

    draw = random.Random(11)
    words = {}
    for _ in range(30):  # families around a stem, with runs of one letter and edits at both ends
        stem = "".join(draw.choice("aabcé") for _ in range(draw.choice([6, 6, 7, 9])))
        for _ in range(8):
            i, kind = draw.randrange(len(stem) + 1), draw.randrange(3)
            word = stem[:i] + draw.choice("abÿ") * (kind < 2) + stem[i + (kind > 0) :]
            words[word] = draw.choice([5, 6, 30, 150, 150, 4000])
    long = 5000 if most_chars > 1000 else 24
    words |= {"a" * k: 5 * 5 ** (k % 3) for k in range(6, 20)} | {"x" * long: 9, "x" * (long // 2) + "y" + "x" * (long // 2 - 1): 50, "x" * (long - 1): 300}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = O.spelling_groups(frame, most_chars=most_chars, shard_chars=shard_chars)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == groups_by_hand(words)
    links = [(r.word, r.near) for r in O.near_words(frame, most_chars=most_chars, shard_chars=shard_chars).collect()]
    assert len(links) == len(set(links)) and all(words[b] for _, b in links)
    empty = frame.where("n < 0")
    assert O.spelling_groups(empty).count() == 0 and O.near_words(empty).count() == 0


def test_spelt_words(spark):
    from scriptorium.llm import op13_spelling as O

    rows = [*ODD, *((i, "Letters ÀÉÎ×÷abc letter5Letters lettres_LETTERSĀÿÿÿÿÿÿ " * 3 + "z" * 40000) for i in range(300)), (None, "Letters"), (8, "Letters")]
    want = {(w, n) for w, n in runs_by_hand(rows).items() if len(w) >= 6 and n >= 5}
    assert {tuple(r) for r in O.spelt_words(docs(spark, rows)).collect()} == want
    assert any(len(w) == 6 and w != "lettre" for w, _ in want)
    assert O.spelt_words(docs(spark, [])).count() == 0


def test_wavelet_tree():
    from scriptorium.llm.op13_spelling import WaveletTree

    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 257):
        values = draw.permutation(n)
        tree = WaveletTree(values)
        box = np.sort(draw.integers(0, n + 1, (50, 2, 2)), axis=2)
        which, found = tree.report(box[:, 0, 0], box[:, 0, 1], box[:, 1, 0], box[:, 1, 1])
        for k, ((a, b), (low, high)) in enumerate(box):
            assert sorted(found[which == k]) == sorted(v for v in values[a:b] if low <= v < high)
