"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

Features are the distinct character n-grams of a text, hashed into ``2 ** HASH_BITS``
places.  Each is scaled by its naive Bayes log-count ratio between toxic and clean
training texts; a logistic regression with an L2 penalty is fitted on top.  Features
whose ratio is within chance (below ``least_z`` standard errors) are left out, so long clean
texts gather no noise.  Scoring hashes a batch's n-grams in whole-buffer passes
and counts each feature once for a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import give_back, slices, tidy

HASH_BITS = 20
GRAMS = (3, 4, 5, 6)
_STEP = np.uint32(0x9E3779B1)


@dataclass
class Model:
    weight: np.ndarray  # float32 for each place, ratio included; 0: no feature
    bias: float

    def chance(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, blanks unified, one blank around each; offsets."""
    flat = [f" {' '.join(t.lower().split())} " for t in texts]
    ends = np.cumsum([0, *map(len, flat)])
    return np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def grams(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the places of all n-grams, and which of them lie inside one document."""
    rolled = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        rolled = (rolled[:m] * _STEP) ^ codes[n - 1 :]
        if n in GRAMS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
            yield (mixed >> np.uint32(32 - HASH_BITS)).astype(np.int32), np.uint32(n)


def hits(codes: np.ndarray, ends: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of the distinct features of each document; ``wanted`` marks the places to keep."""
    docs, places = [], []
    for place, n in grams(codes, ends):
        at = np.flatnonzero(wanted[place]) if wanted is not None else np.arange(len(place))
        owner = np.searchsorted(ends, at, "right") - 1
        inside = at + int(n) <= ends[owner + 1]
        docs.append(owner[inside])
        places.append(place[at[inside]])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(docs).astype(np.int64) << HASH_BITS | np.concatenate(places))
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


def fit(texts: list[str], toxic: list[int], *, least_z: float = 3.0, penalty: float = 1e-3, steps: int = 300) -> Model:
    """The model of labelled texts; without both labels it scores 0 or, if all are toxic, 1."""
    y = np.array(toxic, float)
    size = 1 << HASH_BITS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), 500.0 if len(y) and y[0] else -500.0)
    count = [np.zeros(size), np.zeros(size)]
    for text, label in zip(texts, toxic):
        count[label][hits(*_codes([text]), None)[1]] += 1
    pos, neg = count[1] + 1, count[0] + 1
    ratio = np.log(pos / (y.sum() + 2)) - np.log(neg / ((1 - y).sum() + 2))
    wanted = np.abs(ratio) / np.sqrt(1 / pos + 1 / neg) >= least_z
    column = np.cumsum(wanted) - 1
    # Hashed a second time, so that no list of all features of all texts is held.
    kept = [column[hits(*_codes([t]), wanted)[1]].astype(np.int32) for t in texts]
    scale = ratio[wanted]
    w, bias = np.zeros(len(scale)), 0.0
    moment, speed = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    blocks = range(0, len(kept), 256)  # so that no array of all features of all texts is made in a step
    parts = [(i, min(i + 256, len(kept)), np.concatenate(kept[i : i + 256])) for i in blocks]
    owners = [np.repeat(np.arange(j - i, dtype=np.int32), [len(k) for k in kept[i:j]]) for i, j, _ in parts]
    kept.clear()
    for step in range(1, steps + 1):  # Adam on the whole sample
        own, slope, miss = w * scale, np.zeros(len(scale)), 0.0
        for (i, j, index), row in zip(parts, owners):
            off = 1 / (1 + np.exp(-np.clip(np.bincount(row, own[index], j - i) + bias, -500, 500))) - y[i:j]
            slope += np.bincount(index, off[row], len(scale))
            miss += off.sum()
        grad = np.append(slope * scale / len(y) + penalty * w, miss / len(y))
        moment = 0.9 * moment + 0.1 * grad
        speed = 0.999 * speed + 0.001 * grad**2
        change = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    weight = np.zeros(size, np.float32)
    weight[wanted] = w * scale
    return Model(weight, float(bias))


def score(model: Model, wanted: np.ndarray, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    offs = np.cumsum([0, *map(len, texts)])
    for a, b in slices(offs, 1 << 19):
        codes, ends = _codes(texts[a:b])
        doc, place = hits(codes, ends, wanted)
        out[a:b] = np.bincount(doc, model.weight[place], b - a)
    return model.chance(out)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str, usable: Column, *, train_docs: int, train_chars: int) -> Model:
    """Fits on whole texts of at most ``train_docs`` labelled documents of either label.

    They are chosen by hash, one row of an id, and passed over where they would take
    the sample of a label beyond ``train_chars`` characters.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isin(0, 1) & usable)
    marks = marks.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(toxic_col).cast("int").alias("_toxic"))
    spot = F.xxhash64(F.lit("toxicity"), "_id")
    parts = [marks.where(F.col("_toxic") == t).orderBy(spot, "_id").limit(train_docs) for t in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * train_docs rows of an id and a label
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(chosen, "_id")
    sizes = rows.groupBy("_id", "_toxic").agg(F.max(F.length("_text")).alias("n")).select("_id", "_toxic", "n", spot.alias("spot")).collect()
    left, wanted = [train_chars, train_chars], []
    for r in sorted(sizes, key=lambda r: (r["spot"], r["_id"])):
        if r["n"] <= left[r["_toxic"]]:
            left[r["_toxic"]] -= r["n"]
            wanted.append(r["_id"])
    if not wanted:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame([(i,) for i in wanted], "_id long")
    found = rows.join(F.broadcast(wanted), "_id").groupBy("_id").agg(F.max(F.struct("_toxic", "_text")).alias("r")).collect()
    sample = sorted((r["_id"], r["r"]["_text"], r["r"]["_toxic"]) for r in found)
    found.clear()
    model = fit([r[1] for r in sample], [r[2] for r in sample])
    sample.clear()
    give_back()
    return model


def toxicity_column(model: Model, docs: DataFrame):
    """A function that gives the score of a text column, row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = pd.Series(score(shared.value, shared.value.weight != 0, [x or "" for x in texts]))
        give_back()
        return found

    return scored


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    *,
    train_docs: int = 2000,
    train_chars: int = 20_000_000,
) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, whole texts.

    Learns from rows of ``labels`` where ``usable`` holds; of several labels for an id the
    highest counts, labels other than 0 and 1 and null ids are passed over.  Null and
    empty texts get the score of a text without features.  Repeated rows score
    alike.  An empty table gives no rows; without labels every score is 0.
    """
    model = train(docs, labels, id_col, text_col, toxic_col, usable, train_docs=train_docs, train_chars=train_chars)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.weight != 0
        for batch in batches:
            found = score(shared.value, wanted, [x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch(
                [batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )
            give_back()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, score double, predicted int")
