"""Spelling variants: words one edit apart, by two-dimensional range reporting.

Sorted forward, the words with a given prefix are an interval; sorted by their reversals, so are
those with a given suffix.  A word is a point (its place in either order).  For an edit at position i, the words that
agree with a query before and after i are the points in a rectangle, which a wavelet tree over the
points reports without looking at any other word.

Classes.  All members of a class have the same length.  Words of that length query it for replacements, words one shorter for
insertions; deletions are insertions seen from the other end.

Distribution.  Two words that differ within positions [low, high) agree on what is left and right of that range.  Each
class is first split into two ranges, and a word goes, once for either, to the group of words that
share its rest.  A group of one has no links.  A group of more than ``most_chars`` characters is split again, at the middle of its range;
a range of one position leaves at most one word for each letter of the alphabet.  So no group grows with the
corpus, and none is cut.  Groups are hashed into shards of about ``shard_chars`` characters, with one tree a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import durable

RUN = r"([A-Za-zÀ-ÿ]{%d,})"
_LINKS = "word string, n long, near string, near_n long"


def spelt_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 6, least_n: int = 5, one_in: int = 199
) -> DataFrame:
    """(word, n): words of at least ``least_chars`` code points that occur ``least_n`` times or more.

    Words are maximal runs of Latin letters, A-Z lower-cased.  Of the runs whose hash with the document's id is
    divisible by ``one_in``, one code point is left out.  Null texts hold none, null ids are hashed as
    empty ones, repeated rows count again.  Runs may be of any length.  An empty table gives no rows.
    """
    low = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(low, F.lit(RUN % least_chars), F.lit(1))).alias("run"),
    )
    hashed = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    spot = (hashed % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), spot), F.substring("run", spot + 2, F.length("run")))
    found = runs.select(F.when(hashed % one_in == 0, less).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


class WaveletTree:
    """Points (i, values[i]), ``values`` a permutation; level by level one bit of the values, the zeros' side first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros_before: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1
            self.zeros_before.append(np.r_[0, np.cumsum(1 - one)])
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every point with left <= i < right and low <= value < high."""
        which, node = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros_before):
            half = 1 << (self.bits - 1 - level)
            a, b = zeros[left], zeros[right]
            sides = ((node, a, b), (node + half, zeros[-1] + left - a, zeros[-1] + right - b))
            kept = [(x < y) & (n < high[which]) & (n + half > low[which]) for n, x, y in sides]
            node, left, right = (np.concatenate([side[i][k] for side, k in zip(sides, kept)]) for i in range(3))
            which = np.concatenate([which[k] for k in kept])
        return which, node


def _intervals(order: list[int], words: list[str], member: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row at each place, letters that it shares with the place before, members before each place) of rows in ``order``."""
    rows = np.array(order, np.int64)
    text = "".join(words[i].ljust(width, "\0") for i in order).encode("utf-32-le")
    letters = np.frombuffer(text, np.uint32).reshape(len(order), width)
    shared = np.zeros(len(order), np.int64)
    unlike = letters[1:] != letters[:-1]
    shared[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    return rows, shared, np.r_[0, np.cumsum(member[rows])]


def _span(shared: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the first and last member, as a range, among those that share ``length`` letters with it."""
    place = np.arange(len(shared))
    begin = np.maximum.accumulate(np.where(shared < length, place, 0))
    heads = np.r_[np.flatnonzero(np.r_[True, shared[1:] < length]), len(shared)]
    end = heads[np.searchsorted(heads, place, "right")]
    return before[begin], before[end]


def class_links(words: list[str], role: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of the words of a class that are one edit apart, the edit within the first row's range.

    Role 0: a member, of ``width`` letters; role 1: one letter shorter.  Of several places where a letter can be
    inserted with the same result, the first counts.  Rows may repeat a word with other ranges.
    """
    unlike: dict[tuple[str, int], int] = {}
    of = np.array([unlike.setdefault((w, r), len(unlike)) for w, r in zip(words, role.tolist())], np.int64)
    texts, member = [w for w, _ in unlike], np.array([r == 0 for _, r in unlike])
    if not member.any() or len(texts) < 2:
        return
    back = [w[::-1] for w in texts]
    rows_f, shared_f, before_f = _intervals(sorted(range(len(texts)), key=texts.__getitem__), texts, member, width)
    rows_r, shared_r, before_r = _intervals(sorted(range(len(texts)), key=back.__getitem__), back, member, width)
    place_f, place_r = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    place_f[rows_f] = place_r[rows_r] = np.arange(len(texts))
    members_r = rows_r[member[rows_r]]
    tree = WaveletTree(before_r[place_r[rows_f[member[rows_f]]]])
    some_row = np.empty(len(texts), np.int64)
    some_row[of] = np.arange(len(of))

    def answer(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        row, at, *box = (np.concatenate(x) for x in zip(*parts))
        hit, value = tree.report(*box)
        row, at, found = row[hit], at[hit], members_r[value]
        keep = found != of[row]
        for i in np.flatnonzero(keep & (role[row] == 1) & (at > 0)):
            letters = texts[found[i]]
            keep[i] = letters[at[i]] != letters[at[i] - 1]
        return row[keep], some_row[found[keep]]

    parts, size = [], 0
    for i in range(width):
        asks = np.flatnonzero((low <= i) & (i < high))
        if not len(asks):
            continue
        f, r = place_f[of[asks]], place_r[of[asks]]
        f0, f1 = (x[f] for x in _span(shared_f, before_f, i))
        r0, r1 = (x[r] for x in _span(shared_r, before_r, width - 1 - i))
        full = (f1 - f0 > 1 - role[asks]) & (r1 - r0 > 1 - role[asks])  # a member finds itself
        if full.any():
            parts.append((asks[full], np.full(int(full.sum()), i), f0[full], f1[full], r0[full], r1[full]))
            size += int(full.sum())
        if size > most:
            yield answer(parts)
            parts, size = [], 0
    if parts:
        yield answer(parts)


def _shard_links(table: pa.Table) -> pa.Table:
    """Both directions of every link between words of one shard."""
    columns = {c: table[c].to_numpy() for c in ("n", "width", "low", "high", "role")}
    words = np.array(table["word"].to_pylist(), object)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(columns["width"], kind="stable")
    bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(columns["width"][order]) != 0]), len(order)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = order[a:b]
        role, low, high = (columns[c][rows].astype(np.int64) for c in ("role", "low", "high"))
        for x, y in class_links(words[rows].tolist(), role, low, high, int(columns["width"][rows[0]])):
            longer = role[x] == 1
            left += [rows[x], rows[y[longer]]]
            right += [rows[y], rows[x[longer]]]
    a, b = np.concatenate(left), np.concatenate(right)
    text, n = pa.array(words, pa.string()), columns["n"]
    return pa.table({"word": text.take(pa.array(a)), "n": n[a], "near": text.take(pa.array(b)), "near_n": n[b]})


def _range(width: Column, low: Column, high: Column, role: int) -> Column:
    return F.struct(width.cast("int").alias("width"), low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(role).alias("role"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of the words that agree outside the row's range; a shared hash only brings strangers together."""
    before = F.substring("word", F.lit(1), F.col("low"))
    after = F.substring("word", F.col("high") - F.col("role") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("width", "low", "high", before, after))


def near_words(words: DataFrame, *, most_chars: int = 4_000_000, shard_chars: int = 2_000_000) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words that differ by exactly one inserted, deleted or
    replaced code point.

    ``words`` has distinct, non-null words and their n.  Words may have any length; an empty table gives no rows.
    """
    length = F.length("word")
    ranges = F.array(*(
        _range(width, low, high, role)
        for role, width in ((0, length), (1, length + 1))
        for low, high in ((F.lit(0), F.floor(width / 2)), (F.floor(width / 2), width))
    ))
    rows, ready = words.select("word", "n", F.explode(ranges).alias("r")).select("word", "n", "r.*").where("low < high"), []
    while True:
        keyed = _keyed(rows)
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("role") == 0).alias("members"), F.sum(length.cast("long")).alias("chars"))
        linked = sizes.where("rows > 1 and members > 0").select("key", "chars")
        found = durable(keyed.join(linked, "key").withColumn("large", (F.col("chars") > most_chars) & (F.col("high") - F.col("low") > 1)))
        ready.append(found.where("not large").select("word", "n", "width", "low", "high", "role", "key"))
        large = found.where("large")
        if large.isEmpty():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
        rows = large.select("word", "n", "width", "role", F.explode(halves).alias("h")).select("word", "n", "width", "role", "h.*")
    grouped = reduce(DataFrame.union, ready)
    chars = grouped.agg(F.sum(length.cast("long"))).first()[0] or 0
    shards = -(-chars // shard_chars) or 1
    return grouped.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInArrow(lambda t: _shard_links(t), _LINKS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form), null forms included, lead from each word.  Forms have no cycle."""
    known = durable(forms.where("form is not null").select("word", F.col("form").alias("top")))
    while True:
        step = known.select(F.col("word").alias("top"), F.col("top").alias("next"))
        found = durable(known.join(step.hint("merge"), "top", "left").select("word", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("rose")))
        known = found.select("word", "top")
        if found.where("rose").isEmpty():
            return known.withColumnRenamed("top", "root")


def spelling_groups(words: DataFrame, times: int = 5, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words (word, n)``.

    form: the near word of largest n (ties: the smallest in code-point order) if that is at least ``times`` the word's, else
    null; root: the end of the chain of forms, the word itself where it has none; n_near: near words.  ``options`` are those of ``near_words``.
    """
    words = durable(words.select("word", "n"))
    links = near_words(words, **options)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    met = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rules = -F.col("best.less") >= times * F.col("n")
    found = durable(
        words.join(met.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(rules, F.col("best.near")).alias("form"), F.when(rules, -F.col("best.less")).alias("form_n")
        )
    )
    ends = roots(found).hint("merge")
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
