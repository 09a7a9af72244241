"""Scoring documents with a gated recurrent language model learnt from the corpus.

Counts.  Every training document's words are counted (64-bit word hashes, summed in
each batch before the shuffle).  The ``head`` most frequent words get an output of
their own in one of ``head_classes`` classes of near equal weight.  Every other word falls into
a rare class by its shape (length, letters beyond ASCII, last byte), whose members
share its mass in proportion to count + 0.5; one share stands for the unknown word.

Model.  A GRU (see ``gru``) predicts the class of each token and the member of a head
class.  All training documents are dealt into rounds and, in a round, into groups.  The
groups of a round are trained side by side from the mean of the round before (at first
from the unigram distribution) and averaged.

Texts are read twice: to count their words, and to write their tokens as the model's
inputs (two bytes each), from which it learns and scores.

Scores.  Documents of a batch run side by side, the state carried over windows to
their ends.  Counts of the most frequent words, at most ``known_most``, go to the tasks (a
bounded table); words beyond it meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .cluster import durable
from .textkit import Words, give_back, mix_one, tidy, utf8, words

END = np.uint64(mix_one(0xE0D0F0D0C0))
_LENGTHS, _TAILS = (6, 9), 10
RARE = 2 * (len(_LENGTHS) + 1) * _TAILS
_LN10 = np.log(10.0)
_NO_TAIL = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def shapes(part: Words) -> np.ndarray:
    """The rare class of every word, from its bytes alone."""
    wide = np.zeros(len(part.low) + 1, np.int64)
    np.cumsum(part.low >= 128, out=wide[1:])
    accented = (wide[part.end] > wide[part.start]).astype(np.int32)
    size = np.searchsorted(_LENGTHS, part.end - part.start - 1, "right").astype(np.int32)
    tail = (part.low[part.end - 1] % _TAILS).astype(np.int32) if len(part.end) else np.zeros(0, np.int32)
    return (accented * (len(_LENGTHS) + 1) + size) * _TAILS + tail


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c, shape) over all rows: each distinct word's count; ends not included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(part.hashes(), shapes(part)) for part in words(batch.column(0))]
            if not seen:
                continue
            hashes, shape = (np.concatenate(x) for x in zip(*seen))
            h, first, c = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c), pa.array(shape[first])], names=["h", "c", "shape"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(run), "h long, c long, shape int")
    return counted.groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape"))


@dataclass
class Lexicon:
    total: int  # N
    distinct: int  # V
    hashes: np.ndarray  # known words, ascending
    counts: np.ndarray
    inputs: np.ndarray  # model input of each known word
    end_input: int
    end_count: int
    layout: gru.Layout
    class_log: np.ndarray
    word_log: np.ndarray
    rare_log: np.ndarray  # natural log of each rare class's mass

    start_bits: int = 20

    def __post_init__(self) -> None:
        """Where the hashes of each beginning are found."""
        first = np.arange(1 << self.start_bits, dtype=np.uint64) << np.uint64(64 - self.start_bits)
        self.starts = np.minimum(np.searchsorted(self.hashes, first), max(len(self.hashes) - 1, 0))

    def look_up(self, hashes: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(model input, count, found) of words; the count is 0 where not found."""
        if not len(self.hashes):
            return self.layout.head + shape, np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.starts[(hashes >> np.uint64(64 - self.start_bits)).astype(np.int64)]
        found = self.hashes[at] == hashes
        left = np.flatnonzero(self.hashes[at] < hashes)
        while len(left):  # a few steps to the right, in a short run of like leading bits
            at[left] += 1
            now = self.hashes[np.minimum(at[left], len(self.hashes) - 1)]
            found[left] = (now == hashes[left]) & (at[left] < len(self.hashes))
            left = left[(now < hashes[left]) & (at[left] < len(self.hashes))]
        at = np.minimum(at, len(self.hashes) - 1)
        return (np.where(found, self.inputs[at], self.layout.head + shape).astype(np.int32), np.where(found, self.counts[at], 0), found)


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that no more than ``most`` words occur so often.

    Found from how many words have each count, which is a short table, so no task
    sends more than its share of the words that are wanted.
    """
    seen, least = 0, None
    for c, n in sorted(map(tuple, counts.groupBy("c").agg(F.count(F.lit(1))).collect()), reverse=True):
        seen += n
        if seen > most:
            break
        least = c
    return 1 << 62 if least is None else least


def lexicon(counts: DataFrame, documents: int, head: int, head_classes: int, known_most: int) -> Lexicon:
    """The bounded tables a task needs, from the counts of all words."""
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where(F.col("c") >= _least_count(counts, known_most)).toPandas()
    top = top.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    by_shape = {r["shape"]: (r["n"], r["s"]) for r in counts.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).collect()}
    mass = np.full(RARE, 0.5)
    for shape, (n, s) in by_shape.items():
        mass[shape] += s + 0.5 * n
    h, c, shape = top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64), top["shape"].to_numpy(np.int32)
    best = min(head, len(h))
    for i in range(best):
        mass[shape[i]] -= c[i] + 0.5
    weight = np.append(c[:best] + 0.5, documents + 0.5)  # the end is the last head token
    order = np.argsort(-weight, kind="stable")
    share = np.cumsum(np.sqrt(weight[order]))
    group_of = np.minimum((share - np.sqrt(weight[order])) * head_classes / share[-1], head_classes - 1).astype(np.int32)
    _, group_of = np.unique(group_of, return_inverse=True)
    sizes = np.bincount(group_of)
    member_of = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))  # inputs run by class, as the members do
    classes = np.concatenate([group_of, len(sizes) + np.arange(RARE)])
    members = np.concatenate([member_of, np.zeros(RARE, np.int64)])
    layout = gru.Layout(len(order), RARE, classes, members, sizes)
    sums = np.bincount(group_of, weight[order])
    class_log = np.log(np.concatenate([sums, mass]))
    class_log -= np.log(np.exp(class_log - class_log.max()).sum()) + class_log.max()
    inputs = np.where(np.arange(len(h)) < best, np.append(number[:best], np.zeros(max(0, len(h) - best), np.int32)), layout.head + shape)
    ranked = np.argsort(h)
    return Lexicon(
        int(whole[0]) + documents, int(whole[1]) + (documents > 0), h[ranked], c[ranked], inputs[ranked].astype(np.int32),
        int(number[best]), documents, layout, class_log, np.log(weight[order] / sums[group_of]), np.log(mass),
    )


def encode(docs: DataFrame, lex) -> DataFrame:
    """(doc_id, learnt, spot) of ``docs``, each with what one pass over its ``text`` finds.

    tokens: the model's inputs with the end, in the bytes of ``_code``; n_tokens; n_known, base and rare: the
    known words, the sum of their log10(c + 0.5), and of what the model's rare classes leave of it; tails,
    counts: the words that the tasks' table doesn't hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lex.value
        head, code = known.layout.head, _code(known.layout)
        left = np.append(np.zeros(head), known.rare_log / _LN10)  # of each input
        for batch in batches:
            for part in words(batch.column(3)):
                hashes = part.hashes()
                inputs, count, hit = known.look_up(hashes, shapes(part))
                logs = np.where(hit, np.log10(count + 0.5), 0.0)

                def each(values: np.ndarray) -> np.ndarray:
                    return np.bincount(part.owner, values, part.docs)

                ends = part.bounds[1:] + np.arange(part.docs)
                flat = np.empty(len(inputs) + part.docs, code)
                flat[np.arange(len(inputs)) + part.owner] = inputs
                flat[ends] = known.end_input
                offsets = np.append(0, ends + 1).astype(np.int32) * code.itemsize
                missed = np.flatnonzero(~hit)
                cut = np.searchsorted(part.owner[missed], np.arange(part.docs + 1)).tolist()
                tails = [np.unique(hashes[missed[a:b]], return_counts=True) if a < b else _NO_TAIL for a, b in zip(cut[:-1], cut[1:])]
                columns = [
                    *(batch.column(i).slice(part.first, part.docs) for i in range(3)),
                    pa.array(np.diff(offsets) // code.itemsize, pa.int64()),
                    pa.array(each(hit).astype(np.int64) + (known.end_count > 0), pa.int64()),
                    pa.array(each(logs) + np.log10(known.end_count + 0.5), pa.float64()),
                    pa.array(each(np.where(inputs >= head, logs, 0.0)) - each(left.take(inputs)), pa.float64()),
                    pa.array([h.view(np.int64) for h, _ in tails], pa.list_(pa.int64())),
                    pa.array([c for _, c in tails], pa.list_(pa.int64())),
                    pa.Array.from_buffers(pa.binary(), part.docs, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]),
                ]
                names = ["doc_id", "learnt", "spot", "n_tokens", "n_known", "base", "rare", "tails", "counts", "tokens"]
                yield pa.record_batch(columns, names=names)
            give_back()

    schema = "doc_id long, learnt boolean, spot long, n_tokens long, n_known long, base double, rare double, tails array<long>, counts array<long>, tokens binary"
    return docs.select("doc_id", "learnt", "spot", "text").mapInArrow(tidy(run), schema)


def _code(layout: gru.Layout) -> np.dtype:
    """How an input is written in ``tokens``."""
    return np.dtype("<u2" if layout.inputs <= 1 << 16 else "<u4")


def train(coded: DataFrame, documents: int, lex, layout: gru.Layout, start: np.ndarray, *, rounds: int, group_docs: int) -> np.ndarray:
    """Parameters averaged over groups of about ``group_docs`` documents, in up to ``rounds`` rounds.

    Every row of ``coded`` (spot, tokens), of which there are ``documents``, is in one group of one round.  Groups are
    trained on the executors; only the averages come back.
    """
    groups = max(1, -(-documents // group_docs))
    rounds = min(rounds, groups)
    dealt = coded.select("spot", "tokens").withColumn("lot", F.pmod(F.xxhash64("spot"), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ranked, code = sorted(zip(frame.spot.tolist(), frame.tokens)), _code(layout)
        texts = [np.frombuffer(own, code).astype(np.int32) for _, own in ranked]
        flat = gru.flatten(gru.fit(layout, gru.restore(layout, begin.value), texts, lex.value.end_input))
        pieces = [flat[i : i + 4096].astype(float) for i in range(0, len(flat), 4096)]
        return pd.DataFrame({"piece": range(len(pieces)), "values": pieces})

    for turn in range(rounds):
        begin = coded.sparkSession.sparkContext.broadcast(start)
        trained = dealt.where(F.col("lot") % rounds == turn).groupBy("lot").applyInPandas(run, "piece int, values array<double>")
        means = (
            trained.select("piece", F.posexplode("values").alias("at", "value")).groupBy("piece", "at").agg(F.avg("value").alias("mean")).toPandas()
        )
        if len(means):
            flat = np.empty(len(start))
            flat[means["piece"].to_numpy() * 4096 + means["at"].to_numpy()] = means["mean"].to_numpy()
            start = flat.astype(np.float32)
    return start


def score_documents(
    docs: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    head: int = 1500,
    head_classes: int = 32,
    known_most: int = 1 << 18,
    rounds: int = 4,
    group_docs: int = 4000,
    lot_tokens: int = 6_000_000,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are the words of the whole text, A-Z lower-cased, and one end.  base_score: sum
    of log10((c + 0.5) / (N + 0.5 (V + 1))).  score: the model's log10 probability.
    Rows where ``usable`` holds are learnt from.  Null or empty text: the end alone.
    Repeated rows count as often as they occur and score alike; null ids are scored.  An
    empty table gives no rows; with nothing to learn from every word is unknown.  A task scores
    the texts of several batches side by side, of ``lot_tokens`` tokens and a batch at most.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    key = F.concat_ws("#", F.col(id_col).cast("string"), F.length(text))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(usable, F.lit(False)).alias("learnt"),
        F.xxhash64(F.lit("gru"), key).alias("spot"),
        text.alias("text"),
    )
    learnt = narrow.where("learnt")
    counts, documents = durable(word_counts(learnt, "text")), learnt.count()
    lex_ = lexicon(counts, documents, head, head_classes, known_most)
    lex, layout = spark.sparkContext.broadcast(lex_), lex_.layout
    rows = durable(encode(narrow, lex)).withColumn("row", F.monotonically_increasing_id())
    start = gru.flatten(gru.initial(layout, lex_.class_log, lex_.word_log))
    found = train(rows.where("learnt"), documents, lex, layout, start, rounds=rounds, group_docs=group_docs)
    parameters = spark.sparkContext.broadcast(found)

    def scored(lot: list[tuple[list[pa.Array], list[np.ndarray]]], known: Lexicon, par: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        texts = [t for _, own in lot for t in own]
        scores = gru.score(known.layout, par, texts, known.end_input) / _LN10 if texts else np.zeros(0)
        at = 0
        for (*first, rare), own in lot:
            model = pa.array(scores[at : at + len(own)] + rare, pa.float64())
            at += len(own)
            yield pa.record_batch([*first, model], names=["row", "doc_id", "n_tokens", "n_known", "base", "model"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lex.value
        par, code = gru.restore(known.layout, parameters.value), _code(known.layout)
        lot, size = [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column(6))
            flat, cut = raw.view(code).astype(np.int32), (offsets // code.itemsize).tolist()
            texts = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
            # Copies: the batch's tokens aren't held with them.
            columns = [pa.array(batch.column(i).to_pylist(), batch.column(i).type) for i in range(5)]
            lot.append(([*columns, np.array(batch.column(5))], texts))
            size += len(flat)
            if size >= lot_tokens:
                yield from scored(lot, known, par)
                lot, size = [], 0
            give_back()
        yield from scored(lot, known, par)

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, model double"
    modelled = durable(rows.select("row", "doc_id", "n_tokens", "n_known", "base", "rare", "tokens").mapInArrow(tidy(run), schema))
    tail = rows.select("row", F.explode(F.arrays_zip("tails", "counts")).alias("t")).select("row", F.col("t.tails").alias("h"), F.col("t.counts").alias("n"))
    met = tail.join(counts.select("h", "c"), "h", "left")
    logs = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    # Rounded, so that the order of additions doesn't show.
    sums = met.groupBy("row").agg(F.round(F.sum(F.col("n") * logs), 11).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"))
    joined = modelled.join(sums, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    whole = float(np.log10(lex_.total + 0.5 * (lex_.distinct + 1)))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex_.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
