"""Vectorised text handling on Arrow buffers.

A batch of texts stays one byte buffer with offsets.  Words, 64-bit word hashes
and word shingles come from whole-buffer numpy passes, in slices of about
``SLICE_BYTES`` so that the temporaries stay small however large the batch is.
A word is ``[^\\x20\\x09-\\x0D]+``; A-Z are lower-cased.  Null texts are empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE_WEIGHTS = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def give_back() -> None:
    """Returns freed memory to the system, so that workers that are kept don't hold their peaks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after whose end a worker that is kept holds nothing of the task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each ``raw[start:end]``, by content alone; spans in order."""
    if len(raw) > SLICE_BYTES and len(start) > 1:  # in halves, so that no array of a whole large buffer is made
        mid = len(start) // 2
        sides = [(a, b, int(start[a]), int(end[b - 1])) for a, b in ((0, mid), (mid, len(start)))]
        found = [span_hashes(raw[lo:hi], start[a:b] - lo, end[a:b] - lo, seed) for a, b, lo, hi in sides]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    up, down = _power(len(raw) + 1)
    out = []
    for k in (2 * seed, 2 * seed + 1):
        code = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(mix_one(k + 77)))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(code[raw] * up[: len(raw)], out=total[1:])
        out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return out[0], out[1]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """``flat[start:start + size]`` of all spans, one after another."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        begin = int(ends[at - 1]) if at else 0
        n = size[at:to]
        inner = np.arange(int(n.sum())) + np.repeat(start[at:to] - (np.cumsum(n) - n), n)
        out[begin : begin + len(inner)] = flat[inner]
        at = to
    return out


@dataclass
class Words:
    """Words of the documents ``first .. first + docs``; ``owner`` counts from 0."""

    first: int
    docs: int
    low: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray  # word range of each document

    def hashes(self) -> np.ndarray:
        up, down = _power(len(self.low) + 1)
        total = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[: len(self.low)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def words(column: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """The words of every text of a column, slice by slice."""
    raw, offs = utf8(column)
    for a, b in slices(offs):
        part, local = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        solid = ~_BLANK[part]
        begins, ends = solid.copy(), solid.copy()
        if len(part):
            cut = local[1:-1]
            cut = cut[cut < len(part)]  # first bytes of documents
            before = np.empty(len(part), bool)
            before[0], before[1:] = True, ~solid[:-1]
            before[cut] = True
            after = np.empty(len(part), bool)
            after[-1], after[:-1] = True, ~solid[1:]
            after[cut[cut > 0] - 1] = True
            begins &= before
            ends &= after
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        bounds = np.searchsorted(start, local)
        owner = np.repeat(np.arange(b - a), np.diff(bounds))
        yield Words(a, b - a, _LOWER[part], start, end, owner, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Each document's distinct word shingles as sorted 64-bit hashes.

    A document with fewer words than ``width`` has its whole sequence as the only
    shingle; one without words has none.
    """
    weights = np.array([_SHINGLE_WEIGHTS[i % 5] ^ (i // 5) for i in range(width)], np.uint64)
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled += hashes[i : i + n] * weights[i]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = (hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
