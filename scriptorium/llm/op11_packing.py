"""Bounded-space online packing of token sequences.

Every task reads its documents once, in order, and keeps at most ``open_windows`` sequences
open.  What a document has beyond whole sequences goes, uncut, into the open sequence that it
fills best.  Where it fits in none, and no more may be opened, the fullest one is emitted: as it is if
no more than ``most_padding`` places are left in it, else filled up with the document's first tokens.

What a task leaves open is merged: the open sequences of ``fan`` neighbouring tasks are packed
again by the same rules, then those that stay open of ``fan`` such groups, and so on.  A
group holds at most ``fan * open_windows`` sequences, whatever the corpus holds.  The last group's are
poured together, and the tail becomes sequences whose lengths are powers of two, which need no padding.

Tokens.  A task cuts its texts into pieces by the vocabulary's pattern and lets the ``tokenizers``
library encode each distinct piece once.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable
from .op5_bpe import PATTERN, splits
from .textkit import gather, slices, span_hashes, tidy, utf8

VOCABULARY = "byte_bpe_50k.json"
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean, ids array<int>"
_ARROW = pa.schema([
    *((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")),
    ("open", pa.bool_()), ("ids", pa.list_(pa.int32())),
])

#: A piece: document, place of its first token there, the document's tokens, ids.
Piece = tuple[int | None, int, int, np.ndarray]


def public_vocabulary() -> str:
    """The vocabulary file of the public 50k byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class Encoder:
    """Ids of texts; every distinct piece meets the tokenizer once until ``most_pieces`` are known."""

    def __init__(self, path: str, most_pieces: int = 1_000_000):
        self.path, self.most = path, most_pieces
        self.clear()

    def clear(self) -> None:
        self.hashes, self.second, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, h: np.ndarray, g: np.ndarray, pieces: list[str]) -> None:
        """``pieces`` with their hashes, which ascend."""
        found = [e.ids for e in _tokenizer(self.path).encode_batch_fast(pieces, add_special_tokens=False)]
        spot, number = np.searchsorted(self.hashes, h), len(self.at) - 1 + np.arange(len(pieces))
        self.hashes, self.second, self.entry = (np.insert(x, spot, y) for x, y in ((self.hashes, h), (self.second, g), (self.entry, number)))
        self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)]
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.uint32)])

    def _entries(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash, whether it is known)."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return place, self.hashes[place] == h

    def __call__(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts ``raw[offs[i]:offs[i + 1]]``, bounds of each text's)."""
        at, counts = splits(raw, offs, PATTERN)
        if len(self.hashes) > self.most:
            self.clear()
        h, g = span_hashes(raw, at[:-1], at[1:])
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._entries(kinds)[1])
        if len(new):
            spans = zip(at[first[new]].tolist(), at[first[new] + 1].tolist())
            self._add(kinds[new], g[first[new]], [raw[a:b].tobytes().decode() for a, b in spans])
        place, _ = self._entries(kinds)
        if len(place) and (self.second[place][which] != g).any():  # two pieces of one hash: each text for itself
            texts = [raw[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:])]
            found = [np.array(e.ids, np.uint32) for e in _tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        entry = self.entry[place][which]
        size = self.at[entry + 1] - self.at[entry]
        ends = np.r_[0, np.cumsum(size)]
        return gather(self.flat, self.at[entry], size), ends[np.r_[0, np.cumsum(counts)]]


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One of a worker's own, kept between its tasks: about 40 bytes a piece."""
    return Encoder(path)


class Packer:
    """Open sequences, at most ``most_open``; those that are emitted collect in ``done``."""

    def __init__(self, length: int, most_open: int, most_padding: int):
        self.length, self.most_open, self.most_padding = length, most_open, most_padding
        self.rooms: list[tuple[int, int]] = []  # (room, number) of the open sequences, ascending
        self.open: dict[int, list[Piece]] = {}
        self.done: list[list[Piece]] = []
        self.made = 0

    def document(self, doc: int | None, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.length):
            self.place([(doc, start, len(ids), ids[start : start + self.length])])

    def place(self, item: list[Piece]) -> None:
        """Finds room for the pieces of ``item``, together if they fit."""
        while item:
            size = sum(len(p[3]) for p in item)
            spot = bisect.bisect_left(self.rooms, (size, -1))
            if spot < len(self.rooms):
                room, number = self.rooms.pop(spot)
                self._into(number, room - size, item)
                return
            if len(self.rooms) < self.most_open:
                self.made += 1
                self.open[self.made] = []
                self._into(self.made, self.length - size, item)
                return
            room, number = self.rooms.pop(0)
            if room > self.most_padding:
                head, item = cut(item, room)
                self.open[number] += head
            self.done.append(self.open.pop(number))

    def _into(self, number: int, room: int, item: list[Piece]) -> None:
        self.open[number] += item
        if room:
            bisect.insort(self.rooms, (room, number))
        else:
            self.done.append(self.open.pop(number))

    def pour(self) -> None:
        """Emits what is open, joined to full sequences; the tail in lengths that are powers of two."""
        rest = [p for number in sorted(self.open) for p in self.open[number]]
        self.open, self.rooms = {}, []
        while rest:
            size = sum(len(p[3]) for p in rest)
            head, rest = cut(rest, self.length if size >= self.length else 1 << size.bit_length() - 1)
            self.done.append(head)


def cut(item: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``at`` tokens of the pieces, and the others."""
    head: list[Piece] = []
    for i, (doc, start, total, ids) in enumerate(item):
        if len(ids) > at:
            return head + ([(doc, start, total, ids[:at])] if at else []), [(doc, start + at, total, ids[at:]), *item[i + 1 :]]
        head.append((doc, start, total, ids))
        at -= len(ids)
    return head, []


def _batch(sequences: list[list[Piece]], first: int, part: int, is_open: bool, keep_ids: bool) -> pa.RecordBatch:
    """Rows of the pieces of sequences numbered from ``first``."""
    pieces = [p for s in sequences for p in s]
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    number = np.repeat(first + np.arange(len(sequences)), [len(s) for s in sequences])
    begins = np.r_[0, np.cumsum(sizes)]
    head = np.cumsum([0, *(len(s) for s in sequences)])[:-1]
    ids = pa.array([p[3].astype(np.int32) if is_open or keep_ids else None for p in pieces], pa.list_(pa.int32()))
    columns = [
        pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array(sizes), pa.array([zlib.crc32(p[3].astype("<u4")) for p in pieces], pa.int64()),
        pa.array([p[2] for p in pieces], pa.int64()), pa.array(number, pa.int64()), pa.array(begins[:-1] - np.repeat(begins[head], [len(s) for s in sequences]), pa.int64()),
        pa.array(np.full(len(pieces), part), pa.int64()), pa.array(np.full(len(pieces), is_open)), ids,
    ]
    return pa.record_batch(columns, schema=_ARROW)


def _name(turn: int, part: int) -> int:
    """The number of a task's or group's first sequence."""
    return turn << 56 | part << 31


def _pack(path: str, length: int, most_open: int, most_padding: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, packer, number = TaskContext.get().partitionId(), _encoder(path), Packer(length, most_open, most_padding), 0
        for batch in batches:
            docs, (raw, offs) = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in slices(offs):
                ids, bounds = encoder(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for doc, x, y in zip(docs[a:b], bounds[:-1].tolist(), bounds[1:].tolist()):
                    packer.document(doc, np.r_[ids[x:y], np.uint32(0)])
                if packer.done:
                    yield _batch(packer.done, _name(0, part) + number, part, False, keep_ids)
                    number += len(packer.done)
                    packer.done = []
        if packer.open:
            yield _batch(list(packer.open.values()), _name(0, part) + number, part, True, True)

    return tidy(run)


def _merge(turn: int, fan: int, length: int, most_open: int, most_padding: int, keep_ids: bool, last: bool):
    def run(table: pa.Table) -> pa.Table:
        group = table["part"][0].as_py() // fan
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        ids = table["ids"].combine_chunks()
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype(np.uint32)
        items: dict[int, list[Piece]] = {}
        for i, (s, doc, start, total) in enumerate(zip(*(table[c].to_pylist() for c in ("sequence_id", "doc_id", "start", "doc_tokens")))):
            items.setdefault(s, []).append((doc, start, total, flat[at[i] : at[i + 1]]))
        packer = Packer(length, most_open, most_padding)
        for item in sorted(items.values(), key=lambda x: -sum(len(p[3]) for p in x)):
            packer.place(item)
        if last:
            packer.pour()
        done = len(packer.done)
        found = [_batch(packer.done, _name(turn, group), group, False, keep_ids), _batch(list(packer.open.values()), _name(turn, group) + done, group, True, True)]
        return pa.Table.from_batches(found)

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = 1024,
    open_windows: int = 64,
    most_padding: int = 4,
    fan: int = 8,
    full: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``full`` also token_ids, for each piece.

    A document is the ids of its text, without special tokens (their strings are ordinary text), and a
    last id 0.  start: its ids before the piece; offset: the sequence's ids before it; ids_crc32: of
    the piece's ids as little-endian unsigned 32-bit integers.  Sequences have ``length`` ids, or up to ``most_padding``
    fewer, or a power of two of them.  Documents are cut only where they are longer than a sequence or would leave
    more padding than that.

    Null or empty text: the id 0 alone.  Every row is packed for itself, so repeated ids, null ids and equal
    rows each keep their pieces.  A text of any length is one row's work: its ids are held once.  An empty
    table gives no rows.  ``vocabulary`` must be readable on every worker.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = durable(narrow.mapInArrow(_pack(vocabulary, length, open_windows, most_padding, full), _SCHEMA))
    done, left, turn = found.where("not open"), found.where("open"), 0
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while turn == 0 or parts > 1:
        turn, parts = turn + 1, -(-parts // fan)
        merge = _merge(turn, fan, length, open_windows, most_padding, full, parts == 1)
        found = durable(left.groupBy(F.floor(F.col("part") / fan).alias("group")).applyInArrow(merge, _SCHEMA))
        done, left = done.union(found.where("not open")), found.where("open")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return done.select(*names, *([F.col("ids").alias("token_ids")] if full else []))
