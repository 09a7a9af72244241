"""Byte-level BPE: ranked merges folded by Spark higher-order functions.

A task turns its texts into pieces (the vocabulary's pattern) and numbers the
distinct ones.  Each distinct piece is a byte array in one row of words; there,
``aggregate`` folds the ranked merges over it: in every step the smallest rank
among adjacent pairs, leftmost first, is merged.  Pair ranks are looked up in a
literal map of the vocabulary, (left id, right id) -> id, laid out as two constant
arrays (``rank_map``).  Decoding concatenates the ids' binary pieces, also by a
fold.  The same task then lays the encoded pieces back into each document, in
order.

Pieces that most tasks have are folded once for all of them: a first pass counts in how
many tasks each distinct piece occurs, the ``most_shared`` commonest are folded, and their
ids go to the tasks (a table bounded by that parameter).  A task folds a piece beyond
them once until it knows ``most_words`` of them.  No text is shuffled.

Pieces of over ``fold_most`` bytes would cost the fold quadratic time; an
equivalent merge with a heap takes those.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import durable
from .textkit import gather, give_back, slices, span_hashes, tidy, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
_NONE = 1 << 17
_FREE = 1 << 60
_SIDES = (300_007, 310_019)
_ROWS = (
    "ids array<long>, counts array<int>, seq array<int>, fresh boolean, words array<array<smallint>>, far array<array<int>>"
)


@functools.lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank; read once in a worker, not to be changed."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> merged id for every split of every token into two tokens."""
    return {
        (ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    }


def rank_map(pairs: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays that hold the merged id of a pair (a, b) at ``k = a << 17 | b`` modulo the
    size of one of them, as ``k << 17 | id``.

    ``min(first[k % n] ^ k << 17, second[k % m] ^ k << 17)`` is the id, and at least
    ``_NONE`` for pairs that don't merge, since a foreign entry differs above bit 17.
    """
    sizes = _SIDES
    while True:
        sides = [[_FREE] * n for n in sizes]
        if all(_place(sides, (a << 17 | b) << 17 | r) for (a, b), r in pairs.items()):
            return np.array(sides[0], np.int64), np.array(sides[1], np.int64)
        sizes = tuple(n * 2 + 1 for n in sizes)


def opening(ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> np.ndarray:
    """At ``a * 257 + b`` the fold's first entry of a byte a before a byte b, or before the end (256): the pair's rank above a's id."""
    ids = [ranks[bytes([i])] for i in range(256)]
    return np.array([pairs.get((a, b), _NONE) << 17 | a for a in ids for b in (*ids, -1)], np.int64)


def _place(sides: list[list[int]], entry: int) -> bool:
    """Puts the entry in its place, moving what it finds to the other side, and so on."""
    for turn in range(500):
        side = sides[turn & 1]
        spot = (entry >> 17) % len(side)
        entry, side[spot] = side[spot], entry
        if entry == _FREE:
            return True
    return False


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges of one piece with a heap, n log n."""
    n = len(piece)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue
        alive[j], end[i], after[i] = False, to, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(piece[a : end[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[after[a]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


#: The pattern that ``splits`` follows without the regular expression; any other goes through it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _BLANK = range(4)
_tables: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """The pattern's class of every code point."""
    if "kinds" not in _tables:
        import regex

        place = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
        every = place.tobytes().decode("utf-32-le")
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            for found in regex.finditer(name, every):
                kinds[place[found.start() : found.end()]] = kind
        _tables["kinds"] = kinds
    return _tables["kinds"]


def splits(raw: np.ndarray, offs: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all pieces and the end, pieces of each text) of texts ``raw[offs[i]:offs[i + 1]]``."""
    if pattern != PATTERN:
        import regex

        find = regex.compile(pattern).findall
        pieces = [[len(p.encode()) for p in find(raw[a:b].tobytes().decode())] for a, b in zip(offs[:-1], offs[1:])]
        return np.cumsum([0, *(n for p in pieces for n in p)]), np.array([len(p) for p in pieces], np.int64)
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(len(offs) - 1, np.int64)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each code point
    first = np.zeros(len(code) + 1, bool)
    first[np.searchsorted(at_byte, offs)] = True  # texts begin, or the buffer ends
    kind = _kinds()[code]
    cut = first[:-1].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(cut)
    ends = np.r_[runs[1:], len(code)]
    cut = np.r_[cut, True]
    # The last of several blanks before other text stands alone or, if a space, begins the next piece.
    blank = (kind[runs] == _BLANK) & ~first[ends]
    last = ends[blank] - 1
    cut[last] = True
    spaced = code[last] == 32
    cut[last[spaced] + 1] = False
    # A single apostrophe without a space takes the letters of a contraction.
    mark = (kind[runs] == _OTHER) & (ends - runs == 1) & (code[runs] == 39) & cut[runs] & ~first[ends]
    for place, stop in zip(ends[mark].tolist(), np.r_[ends, 0][np.flatnonzero(mark) + 1].tolist()):
        short = "".join(map(chr, code[place : min(stop, place + 2)]))
        n = 1 if short[:1] in ("s", "t", "m", "d") else 2 if short in ("re", "ve", "ll") else 0
        if n and kind[place] == _LETTER:
            cut[place] = False
            cut[place + n] = True
    starts = np.flatnonzero(cut[:-1])
    counts = np.diff(np.searchsorted(starts, np.searchsorted(at_byte, offs)))
    return np.r_[at_byte[starts], len(raw)], counts


def _known(ranks: dict[bytes, int], seed: int, extra: tuple[np.ndarray, np.ndarray] | None) -> list[np.ndarray]:
    """[hash, second hash, entry] of all tokens and of extra pieces, hashes ascending."""
    tokens = sorted(ranks, key=ranks.get)
    flat, offs = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
    h, g = span_hashes(flat, offs[:-1], offs[1:], seed)
    entry = np.array([ranks[t] for t in tokens], np.int64)
    if extra is not None and len(extra[1]) > 1:
        h2, g2 = span_hashes(extra[0], extra[1][:-1], extra[1][1:], seed)
        h, g, entry = np.r_[h, h2], np.r_[g, g2], np.r_[entry, max(ranks.values()) + 1 + np.arange(len(h2))]
    order = np.argsort(h)
    return [h[order], g[order], entry[order]]


def _find(known: list[np.ndarray], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The entry of each hash, -1 where unknown; raises where two pieces share a hash."""
    at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
    met = known[0][at] == h
    if (known[1][at[met]] != g[met]).any():
        raise _Clash
    return np.where(met, known[2][at], -1)


class _Clash(Exception):
    """Two pieces share a 64-bit hash; another seed parts them."""


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct hash, which of them each is)."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if (g[first][which] != g).any():
        raise _Clash
    return first, which


def _presence(ranks_path: str, pattern: str, fold_most: int):
    """A row for each distinct piece of a task that is no token and not long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _known(read_ranks(ranks_path), 0, None)[0]
        for batch in batches:
            raw, offs = utf8(batch.column(0))
            for a, b in slices(offs):
                part = raw[offs[a] : offs[b]]
                at, _ = splits(part, offs[a : b + 1] - offs[a], pattern)
                h, _ = span_hashes(part, at[:-1], at[1:], 0)
                h, first = np.unique(h, return_index=True)
                spot = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
                new = seen[spot] != h
                seen = np.sort(np.r_[seen, h[new]])
                first = first[new]
                size = at[first + 1] - at[first]
                first, size = first[size <= fold_most], size[size <= fold_most]
                flat = gather(part, at[first], size)
                yield pa.record_batch([_binary(flat, size)], names=["piece"])
            give_back()

    return tidy(run)


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    offs = np.cumsum(np.r_[0, size]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of 1024 words from rows of one piece each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            flat, offs = utf8(batch.column(0).slice(at, 1024))
            words = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.astype(np.int16)))
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=["words"])


@dataclass
class Shared:
    """Pieces folded for all tasks: their bytes and their ids, each with offsets."""

    flat: np.ndarray
    offs: np.ndarray
    ids: np.ndarray
    at: np.ndarray


def share(texts: DataFrame, ranks_path: str, pattern: str, fold_most: int, most_shared: int) -> Shared:
    """The pieces that occur in most tasks, at most ``most_shared``, folded."""
    none = Shared(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64))
    found = texts.mapInArrow(_presence(ranks_path, pattern, fold_most), "piece binary").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    found = durable(found.where("n > 1"))
    seen, least = 0, None
    for n, kinds in sorted(map(tuple, found.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True):
        seen += kinds
        if seen > most_shared:
            break
        least = n
    if least is None:
        return none
    words = found.where(F.col("n") >= least).select("piece").mapInArrow(_packs, "words array<array<smallint>>")
    table = _fold(words, read_ranks(ranks_path), []).toArrow()
    tokens, spelt = (pa.chunked_array([c for c in table.column(n).chunks]).combine_chunks().flatten() for n in ("tokens", "bytes"))
    flat, offs = utf8(spelt)
    at = tokens.offsets.to_numpy().astype(np.int64)
    return Shared(flat.copy(), offs.copy(), tokens.values.to_numpy()[at[0] : at[-1]].astype(np.uint32), at - at[0])


def _cut(ranks_path: str, pattern: str, flush_bytes: int, fold_most: int, most_words: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, extra, seed = read_ranks(ranks_path), shared.value, 0
        base = max(ranks.values()) + 1 + len(extra.offs) - 1
        known, held, fresh = _known(ranks, seed, (extra.flat, extra.offs)), 0, True
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for batch in batches:
            docs, (raw, offs) = batch.column(0), utf8(batch.column(1))
            batch = None
            for a, b in slices(offs, flush_bytes):
                part = raw[offs[a] : offs[b]]
                at, counts = splits(part, offs[a : b + 1] - offs[a], pattern)
                while True:
                    try:
                        h, g = span_hashes(part, at[:-1], at[1:], seed)
                        first, which = _distinct(h, g)
                        entry = _find(known, h[first], g[first])
                        break
                    except _Clash:
                        seed += 1
                        known, held, fresh = _known(ranks, seed, (extra.flat, extra.offs)), 0, True
                new = np.flatnonzero(entry < 0)
                size = at[first[new] + 1] - at[first[new]]
                new = new[np.argsort(size > fold_most, kind="stable")]  # words before long pieces
                entry[new] = base + held + np.arange(len(new))
                begin, size = at[first[new]], at[first[new] + 1] - at[first[new]]
                short = int((size <= fold_most).sum())
                spelt = gather(part, begin[:short], size[:short]).astype(np.int16)
                words = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, size[:short]]), pa.int32()), pa.array(spelt))
                far = [merge_long(part[x : x + n].tobytes(), ranks) for x, n in zip(begin[short:], size[short:])]
                yield pa.record_batch(
                    [
                        one(docs.slice(a, b - a).cast(pa.int64())),
                        one(pa.array(counts, pa.int32())),
                        one(pa.array(entry[which], pa.int32())),
                        pa.array([fresh]),
                        one(words),
                        one(pa.array(far, pa.list_(pa.int32()))),
                    ],
                    names=["ids", "counts", "seq", "fresh", "words", "far"],
                )
                held += len(new)
                fresh = held >= most_words
                if fresh:
                    known, held = _known(ranks, seed, (extra.flat, extra.offs)), 0
                elif len(new):
                    place = np.argsort(h[first[new]])
                    more = [h[first[new]][place], g[first[new]][place], entry[new][place]]
                    spot = np.searchsorted(known[0], more[0])
                    known = [np.insert(k, spot, m) for k, m in zip(known, more)]
            raw = part = None
            give_back()

    return tidy(run)


def _fold(rows: DataFrame, ranks: dict[bytes, int], keep: list[str]) -> DataFrame:
    """``tokens`` (ids of each of the ``words``), ``bytes`` (each word decoded again) and the columns to keep."""
    spark = rows.sparkSession
    pairs = pair_ranks(ranks)
    sides = rank_map(pairs)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    literal = spark.createDataFrame(
        pa.table({
            "first": pa.array([sides[0]], pa.list_(pa.int64())),
            "second": pa.array([sides[1]], pa.list_(pa.int64())),
            "opening": pa.array([opening(ranks, pairs)], pa.list_(pa.int64())),
            "pieces": pa.array([pieces], pa.list_(pa.binary())),
        })
    )
    known = rows.withColumns({c: literal.select(c).scalar() for c in literal.columns})

    one, two = map(len, sides)

    def joint(a: str, b: str) -> str:
        """Rank of the pair (a, b) above the id a; without a pair ``_NONE`` above it."""
        first = f"get(first, cast(k % {one} as int)) ^ shiftleft(k, 17)"
        second = f"get(second, cast(k % {two} as int)) ^ shiftleft(k, 17)"
        rank = f"least({first}, {second}, {_NONE}L)"
        return f"transform(array(shiftleft({a}, 17) + {b}), k -> shiftleft(if(k is null, {_NONE}L, {rank}), 17) + {a})[0]"

    # State: for each part its rank with the right neighbour above its id.  Equal ranks are
    # equal pairs, so the least entry is the least rank, and its first place the leftmost.
    start = "transform(w, (b, i) -> get(opening, cast(b as int) * 257 + coalesce(cast(get(w, i + 1) as int), 256)))"
    none = "cast(array() as array<bigint>)"
    id_at = "(get(s, {}) & 131071L)"
    left = f"if(at > 1, array({joint(id_at.format('at - 2'), 'm')}), {none})"
    right = f"array({joint('m', id_at.format('at + 1'))})"
    merged = f"concat(slice(s, 1, greatest(at - 2, 0)), {left}, {right}, slice(s, at + 2, size(s)))"
    placed = f"transform(array(cast(array_position(s, low) as int)), at -> transform(array(shiftright(low, 17)), m -> {merged})[0])[0]"
    step = f"transform(array(array_min(s)), low -> if(low >= {_NONE << 17}L, s, {placed}))[0]"
    fold = f"aggregate(sequence(1, greatest(size(w) - 1, 1)), {start}, (s, i) -> {step}, s -> transform(s, x -> x & 131071L))"
    tokens = known.withColumn("tokens", F.expr(f"transform(words, w -> {fold})"))
    decode = "aggregate(t, cast('' as binary), (acc, k) -> concat(acc, get(pieces, cast(k as int))))"
    return tokens.withColumn("bytes", F.expr(f"transform(tokens, t -> {decode})")).select(
        *keep, F.col("tokens").cast("array<array<int>>").alias("tokens"), "bytes"
    )


class _Pool:
    """Entries of values: ``flat[at[i]:at[i + 1]]``, those of all tasks first and then those of this one."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.first = flat, at
        self.clear()

    def clear(self) -> None:
        self.flat, self.at = np.zeros(0, self.first[0].dtype), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = len(self.first[1]) - 1
        known, own = np.flatnonzero(entries < base), np.flatnonzero(entries >= base)
        sizes = np.zeros(len(entries), np.int64)
        for which, (flat, at), less in ((known, self.first, 0), (own, (self.flat, self.at), base)):
            sizes[which] = at[entries[which] - less + 1] - at[entries[which] - less]
        begin = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), self.flat.dtype)
        for which, (flat, at), less in ((known, self.first, 0), (own, (self.flat, self.at), base)):
            for part in (which[i : i + 65536] for i in range(0, len(which), 65536)):
                n = sizes[part]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(begin[part], n) + inner] = flat[np.repeat(at[entries[part] - less].astype(np.int64), n) + inner]
        return out, sizes


def _lay(ranks_path: str, full: bool, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, extra = read_ranks(ranks_path), shared.value
        spell = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spell[rank] = token
        spelling = np.frombuffer(b"".join(spell), np.uint8)
        spans = np.cumsum([0, *map(len, spell)])
        ids = _Pool(np.r_[np.arange(len(spell), dtype=np.uint32), extra.ids], np.r_[np.arange(len(spell) + 1), len(spell) + extra.at[1:]].astype(np.int32))
        bytes_ = _Pool(np.r_[spelling, extra.flat], np.r_[spans, spans[-1] + extra.offs[1:]].astype(np.int32))
        for batch in batches:
            for r in range(batch.num_rows):
                docs, counts, seq, far, fresh, tokens, decoded = (batch.column(i)[r] for i in range(7))
                if fresh.as_py():
                    ids.clear()
                    bytes_.clear()
                for found in (tokens.values, far.values):
                    at = found.offsets.to_numpy().astype(np.int64)
                    ids.add(found.values.to_numpy()[at[0] : at[-1]].astype(np.uint32), np.diff(at))
                flat, offs = utf8(decoded.values)
                bytes_.add(flat, np.diff(offs))
                for found in far.values.to_pylist():
                    long = b"".join(map(spell.__getitem__, found))
                    bytes_.add(np.frombuffer(long, np.uint8), np.array([len(long)]))
                entries, bounds = seq.values.to_numpy(), np.cumsum(np.r_[0, counts.values.to_numpy()])
                numbers, sizes = ids.take(entries)
                text, widths = bytes_.take(entries)
                id_at, byte_at = (np.r_[0, np.cumsum(x)][bounds] for x in (sizes, widths))
                packed = numbers.astype("<u4")
                columns = [
                    docs.values,
                    pa.array(np.diff(id_at), pa.int64()),
                    pa.array([hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(id_at[:-1], id_at[1:])], pa.string()),
                    pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(byte_at[:-1], byte_at[1:])], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns.append(pa.array([numbers[a:b].astype(np.int32) for a, b in zip(id_at[:-1], id_at[1:])], pa.list_(pa.int32())))
                    columns.append(pa.array([text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(byte_at[:-1], byte_at[1:])], pa.string()))
                    names += ["token_ids", "decoded"]
                yield pa.record_batch(columns, names=names)

    return tidy(run)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    full: bool = False,
    flush_bytes: int = 1 << 20,
    fold_most: int = 512,
    most_words: int = 600_000,
    most_shared: int = 1 << 19,
    apart: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``full`` also token_ids and decoded.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the decoded bytes.  Null or empty text: no tokens.  Every row
    is encoded for itself, so repeated ids, null ids and equal rows each give a row.
    ``ranks_path`` must be readable on every worker.  An empty table gives no rows.  ``apart`` writes the folded
    pieces between the two Python passes: more disk, half the workers at a time.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(share(narrow.select("text"), ranks_path, pattern, fold_most, most_shared))
    cut = narrow.mapInArrow(_cut(ranks_path, pattern, flush_bytes, fold_most, most_words, shared), _ROWS)
    folded = _fold(cut, read_ranks(ranks_path), ["ids", "counts", "seq", "far", "fresh"])
    folded = durable(folded) if apart else folded
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return folded.mapInArrow(_lay(ranks_path, full, shared), schema + (", token_ids array<int>, decoded string" if full else ""))


def public_vocabulary(spark: SparkSession | None = None) -> tuple[str, str]:
    """(rank file, pattern) of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
