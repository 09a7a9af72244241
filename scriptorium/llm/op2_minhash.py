"""Near-duplicate detection: MinHash with tensored banding, verified on full sets.

Signature.  2 * ``tables`` half-keys per document, each hashing ``rows`` minima of
the document's shingle hashes: ``tables`` in collection A, as many in B.
Table (i, j) has the key (A_i, B_j), so ``tables ** 2`` tables come from
``2 * tables * rows`` minima, about a square root of what independent tables of
the same width would need.  A pair of similarity s shares a key with probability
``(1 - (1 - s ** rows) ** tables) ** 2``.

Classes.  Documents with equal shingle sets form a class; the smallest doc_id
stands for it, so copies never meet in a bucket.

Candidates.  Pairs that share a bucket.  A bucket links each member to one centre (a
star): the member whose half-keys are commonest, since that is near the middle of its
group.  Where a batch alone holds ``hot`` members of a bucket, they are linked to a
centre there and only that one is shuffled on, so that one bucket never fills a task.
All stars are confirmed on full sets.

Families.  Members of a bucket are always connected by stars, so every candidate pair
lies in one family (component of the stars).  Families whose members are in several
components once the stars are confirmed are searched again without loss, by what
each member differs in from one reference set of the family (``_open_pairs``).  So sharing
no key is the only way in which a link can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import durable, release
from .components import bridges, connected_components, merged
from .textkit import give_back, mix, mix_one, shingles, tidy, words

_SEED = 0x5DEECE66D
_NOTE = "doc_id long, n_shingles long, d1 long, d2 long, halves binary"


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(_SEED))
    return draw[:count] | np.uint64(1), draw[count:]


def half_keys(found: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """The 2 * tables half-keys of one shingle set, A's before B's."""
    by, plus = _multipliers(2 * tables * rows)
    least = np.full(len(by), 2**64 - 1, np.uint64)
    for a in range(0, len(found), 512):
        least = np.minimum(least, (found[a : a + 512, None] * by + plus).min(axis=0))
    least = least.reshape(2 * tables, rows) >> np.uint64(16)
    key = np.zeros(2 * tables, np.uint64)
    for r in range(rows):
        key = mix(key + least[:, r] + np.uint64(r + 1))
    return key


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, tables: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, halves): set size, 128-bit set digest, half-keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            size, d1, d2, halves = [], [], [], []
            for part in words(batch.column(1)):
                for found in shingles(part.hashes(), part.bounds, width):
                    size.append(len(found))
                    d1.append(int(mix(found + np.uint64(1)).sum(dtype=np.uint64)))
                    d2.append(int(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                    halves.append(half_keys(found, tables, rows).tobytes() if len(found) else None)
            yield pa.record_batch(
                [
                    ids.cast(pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(d1, np.uint64).view(np.int64)),
                    pa.array(np.array(d2, np.uint64).view(np.int64)),
                    pa.array(halves, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "halves"],
            )
            give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), _NOTE)


def _common_halves(reps: DataFrame, tables: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest half-keys, at most ``most``, hashes ascending.

    They only say which member of a bucket is its centre, not who is compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, n = np.unique(_slots(batch.column(0), tables), return_counts=True)
            yield pa.record_batch([pa.array(half.view(np.int64)), pa.array(n)], names=["half", "n"])

    counts = reps.select("halves").mapInArrow(tidy(run), "half long, n long").groupBy("half").agg(F.sum("n").alias("n")).where("n > 2")
    counts = durable(counts)
    few = counts.count() <= most
    seen, least = 0, 0 if few else None
    for n, kinds in [] if few else sorted(map(tuple, counts.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True):
        seen += kinds
        if seen > most:
            break
        least = n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.col("n") >= least).toPandas()
    half = found.half.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(half)
    return half[order], found.n.to_numpy(np.int64)[order]


def _slots(halves: pa.Array, tables: int) -> np.ndarray:
    """Half-keys as numbers that also tell their places."""
    half = np.frombuffer(b"".join(halves.to_pylist()), np.uint64).reshape(len(halves), 2 * tables)
    return mix(half + np.arange(1, 2 * tables + 1, dtype=np.uint64))


def _bucket_rows(reps: DataFrame, tables: int, hot: int, common: tuple[np.ndarray, np.ndarray] | None = None, firsts: range | None = None) -> DataFrame:
    """(key, weight, rep, centre): a row for each bucket of each representative.  Rows with
    a centre are links made inside a batch already; their key only spreads them.  ``firsts``: only
    the tables of these first half-keys."""
    salt = np.array([mix_one(7919 * (t + 1)) for t in range(tables * tables)], np.uint64)
    shared = reps.sparkSession.sparkContext.broadcast(common or (np.zeros(0, np.uint64), np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                half = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(ids), 2 * tables)
                weight = np.zeros(len(ids), np.int64)
                if len(known):
                    slots = _slots(batch.column(1), tables)
                    spot = np.minimum(np.searchsorted(known, slots), len(known) - 1)
                    weight = np.where(known[spot] == slots, counts[spot], 0).sum(axis=1)
                rank = np.argsort(np.lexsort((ids, -weight)))  # the most common first, then by id
                keys, reps_, centres, weights = [], [], [], []
                for i in firsts or range(tables):
                    for j in range(tables):
                        key = mix((half[:, i] ^ salt[i * tables + j]) + half[:, tables + j] * np.uint64(0x9E3779B97F4A7C15))
                        order = np.lexsort((rank, key))
                        k, r = key[order], ids[order]
                        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
                        count = np.diff(np.r_[first, len(k)])
                        centre = np.repeat(r[first], count)
                        local = np.repeat(count >= hot, count) & (r != centre)
                        keys.append(np.where(local, mix(r.view(np.uint64)), k).view(np.int64))
                        reps_.append(r)
                        weights.append(weight[order])
                        centres.append((centre, local))
                local = np.concatenate([x for _, x in centres]) if centres else np.zeros(0, bool)
                rows = pa.record_batch(
                    [
                        pa.array(np.concatenate(keys)),
                        pa.array(np.concatenate(weights)),
                        pa.array(np.concatenate(reps_)),
                        pa.array(np.concatenate([x for x, _ in centres]), mask=~local),
                    ],
                    names=["key", "weight", "rep", "centre"],
                )
                if local.any():  # a batch repeats the same local link in many tables
                    names = ["key", "weight", "rep", "centre"]
                    yield from pa.Table.from_batches([rows]).group_by(names).aggregate([]).select(names).to_batches()
                else:
                    yield rows
            give_back()

    return reps.select("rep", "halves").mapInArrow(tidy(run), "key long, weight long, rep long, centre long")


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b, hits) from bucket rows: member, centre, and how many buckets say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, centre_now = None, 0
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            rep = batch.column(2).to_numpy(zero_copy_only=False)
            made = batch.column(3)
            ready = made.is_valid().to_numpy(zero_copy_only=False)
            ends = [(rep[ready], made.filter(made.is_valid()).to_numpy(zero_copy_only=False))]
            k, r = key[~ready], rep[~ready]
            if len(k):
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                lead = r[first].copy()
                if key_now is not None and key_now == k[0]:
                    lead[0] = centre_now
                centre = np.repeat(lead, np.diff(np.r_[first, len(k)]))
                key_now, centre_now = k[-1], lead[-1]
                pick = r != centre
                ends.append((r[pick], centre[pick]))
            a, b = (np.concatenate([e[i] for e in ends]).astype(np.int64) for i in (0, 1))
            if len(a):
                found = pa.table({"a": a, "b": b}).group_by(["a", "b"]).aggregate([([], "count_all")])
                yield from found.select(["a", "b", "count_all"]).rename_columns(["a", "b", "hits"]).to_batches()

    spread = rows.repartition("key").sortWithinPartitions("key", F.col("weight").desc(), "rep")
    return spread.mapInArrow(tidy(run), "a long, b long, hits long").groupBy("a", "b").agg(F.sum("hits").alias("hits"))


def _sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, width: int, bits_log2: int = 23) -> DataFrame:
    """(rep, found): the full sets of the wanted representatives.

    A bitmap of ``2 ** bits_log2`` bits (1 MB) made of the wanted ids goes to the
    tasks; documents it excludes are not even split into words.  The exact join
    afterwards makes the result independent of the bitmap's size.
    """
    spot = F.pmod(F.xxhash64(F.col("rep")), F.lit(1 << bits_log2))
    cells = (
        wanted.select(spot.alias("s"))
        .groupBy(F.shiftright("s", 5).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits"))
    )
    bitmap = np.zeros(1 << (bits_log2 - 5), np.uint32)
    found = cells.toPandas()  # bounded by the bitmap's size
    bitmap[found.cell.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            keep = (shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            sets = []
            for part in words(batch.column(1)):
                sets += [x.tobytes() for x in shingles(part.hashes(), part.bounds, width)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "found"])
            give_back()

    base = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).where("rep is not null")
    sets = base.select("rep", "text", spot.alias("s")).mapInArrow(tidy(run), "rep long, found binary")
    return sets.join(wanted.hint("merge"), "rep", "left_semi")


def _turns(size: int, each: int, most: int = 5) -> int:
    """One turn for each ``each`` of what is shuffled, ``most`` at most: small tables aren't worth more."""
    return max(1, min(most, -(-size // each)))


def _in_turns(make, turns: int, release_with) -> DataFrame:
    """The rows of ``make(turn)`` of all turns; what a turn shuffled is dropped before the next one begins."""
    found = None
    for turn in range(turns):
        rows = durable(make(turn))
        release(release_with)
        found = rows if found is None else found.union(rows)
    return found


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the full sets ``fa`` and ``fb`` of their ends."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("found").alias("fa")).hint("merge"), "a")
    return left.join(sets.select(F.col("rep").alias("b"), F.col("found").alias("fb")).hint("merge"), "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, judged on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs.select("a", "b"), sets).select("a", "b", "fa", "fb").mapInArrow(tidy(run), "a long, b long")


def _references(members: DataFrame, sets: DataFrame, ballot: int = 15) -> DataFrame:
    """(fam, ref): the shingles that most of up to ``ballot`` members of each family have.

    Any set would do as a reference; one near the middle makes the differences short.
    """
    turn = F.row_number().over(W.partitionBy("fam").orderBy(F.xxhash64("rep"), "rep"))
    voters = members.select("fam", "rep").withColumn("turn", turn).where(F.col("turn") <= ballot)
    votes = voters.join(sets.hint("merge"), "rep").groupBy("fam").agg(F.collect_list("found").alias("votes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = []
            for votes in batch.column(1).to_pylist():
                el, n = np.unique(np.frombuffer(b"".join(votes), np.uint64), return_counts=True)
                refs.append(el[2 * n > len(votes)].tobytes())
            yield pa.record_batch([batch.column(0), pa.array(refs, pa.binary())], names=["fam", "ref"])

    return votes.mapInArrow(tidy(run), "fam long, ref binary")


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(fam, rep, comp, n, e, slack, els) of members (fam, rep, comp).

    E is what a member's set and its family's reference don't have in common, e its size, n
    the member's own.  ``els`` are the first of E's elements, as many as any link can need.
    """
    low, high = 100 - percent, 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, es, els = [], [], []
            for x, r in zip(batch.column(3), batch.column(4)):
                x, r = (np.frombuffer(v.as_py(), np.uint64) for v in (x, r))
                more, less = np.setdiff1d(x, r, assume_unique=True), np.setdiff1d(r, x, assume_unique=True)
                # Elements beyond the reference are the rarer ones and come first.
                first = np.concatenate([part[np.argsort(mix(part))] for part in (more, less)])
                sizes.append(len(x))
                es.append(len(first))
                els.append(first[: low * len(x) // percent + 1].view(np.int64))
            yield pa.record_batch(
                [*(batch.column(i) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(es, pa.int64()), pa.array(els, pa.list_(pa.int64()))],
                names=["fam", "rep", "comp", "n", "e", "els"],
            )

    full = members.select("fam", "rep", "comp").join(sets.hint("merge"), "rep").join(_references(members, sets).hint("merge"), "fam")
    rows = full.select("fam", "rep", "comp", "found", "ref").mapInArrow(tidy(run), "fam long, rep long, comp long, n long, e long, els array<long>")
    return rows.withColumn("slack", low * F.col("n") - high * F.col("e"))


def _open_pairs(stars: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, crowd: int) -> DataFrame:
    """Pairs (a, b) across components that may be links, from families with several components.

    Sets x and y are linked if and only if ``|E_x ^ E_y| <= t (|x| + |y|)``, where E is the
    difference from any one reference and t = (100 - percent) / (100 + percent): if E_x
    and E_y share at least ``-(slack_x + slack_y) / 2`` elements, slack = t |x| - e_x.

    * Where the slacks of a pair sum to 0 or more, both are links of the family's member with
      the most slack, the lead.  Each member that is so (a near one) is paired with it.
    * Of other pairs one is not near.  They share at least one element, so under one order
      of all elements they share one among the first ``e - least + 1``, least being
      the least number that a link needs: over ``(slack_lead - slack_x) / 2`` for any x with a
      member that isn't near, and at least ``e - (100 - percent) / percent * n`` for any.

    An element that over ``crowd`` members have so early makes them a family of their own,
    with a reference of its own; after four such turns they meet as they are.
    """
    high = 100 + percent
    between = durable(bridges(groups, stars))
    if between.isEmpty():
        return between
    families = connected_components(between).toDF("component", "fam")
    placed = groups.join(families.hint("merge"), "component").select("fam", F.col("node").alias("rep"), F.col("component").alias("comp"))
    several = placed.groupBy("fam").agg(F.count(F.lit(1)).alias("size")).where("size > 2").select("fam")
    members = durable(placed.join(several.hint("merge"), "fam", "left_semi"))
    found = None
    for turn in range(5):
        rows = durable(_differences(members, sets, percent))
        top = F.struct("slack", "rep")
        lead = rows.groupBy("fam").agg(F.max_by("rep", top).alias("lead"), F.max_by("comp", top).alias("first"), F.max("slack").alias("most"))
        rows = rows.join(lead.hint("merge"), "fam").withColumn("near", F.col("slack") + F.col("most") >= 0)
        met = rows.where("near and comp <> first").select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b"))
        least = F.greatest(F.floor((F.col("most") - F.col("slack")) / F.lit(2 * high)) + 1, F.lit(1))
        rows = rows.withColumn("within", F.col("e") - least + 1)
        first = F.when(F.col("near"), F.slice("els", F.lit(1), F.greatest(F.col("within"), F.lit(0)).cast("int"))).otherwise(F.col("els"))
        elements = rows.select("fam", "rep", "comp", "n", "e", "slack", "near", "within", F.posexplode(first).alias("at", "el"))
        elements = durable(elements.withColumn("inner", F.col("at") < F.col("within")).drop("within", "at"))
        shared = elements.groupBy("fam", "el").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("one"), F.max("comp").alias("two"))
        crowded = (F.col("k") > (crowd if turn < 4 else 1 << 62)).alias("crowded")
        shared = durable(shared.where("one < two").select("fam", "el", crowded))
        crowds = shared.where("crowded").select("fam", "el")
        meeting = elements.join(shared.where("not crowded").hint("merge"), ["fam", "el"], "left_semi")
        x, y = meeting.alias("x"), meeting.alias("y")
        roles = "x.inner and y.inner and not (x.near and y.near) or x.near and x.inner and not y.near or y.near and y.inner and not x.near"
        fits = f"-(x.slack + y.slack) <= {2 * high} * least(x.e, y.e) and 100 * least(x.n, y.n) >= {int(percent)} * greatest(x.n, y.n)"
        same = (F.col("x.fam") == F.col("y.fam")) & (F.col("x.el") == F.col("y.el"))
        pairs = x.join(y.hint("merge"), same & F.expr(f"x.rep < y.rep and x.comp <> y.comp and ({roles}) and {fits}"))
        pairs = met.union(pairs.select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")))
        found = pairs if found is None else found.union(pairs)
        if crowds.isEmpty():
            break
        inside = elements.join(crowds.hint("merge"), ["fam", "el"], "left_semi")
        members = durable(inside.select(F.xxhash64("fam", "el").alias("fam"), "rep", "comp"))
    return found.distinct()


def _ends(stars: DataFrame, name: str) -> DataFrame:
    return stars.select(F.explode(F.array("a", "b")).alias(name)).distinct()


def _confirm(stars: DataFrame, sets: DataFrame, percent: int, crowd: int = 128, turns: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) from links confirmed on full sets: those of all stars, then those
    that ``_open_pairs`` finds between components.  Pairs that carry sets are dealt in turns, by one end.
    ``nodes``: the stars' ends, if they are at hand."""
    spark, turn_of = stars.sparkSession, F.pmod(F.xxhash64("b"), F.lit(turns))
    in_turns = lambda pairs: _in_turns(lambda turn: _linked(pairs.where(turn_of == turn), sets, percent), turns, spark)
    nodes = _ends(stars, "node") if nodes is None else nodes
    solved = connected_components(in_turns(stars))
    groups = durable(nodes.join(solved.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    more = durable(_open_pairs(stars, groups, sets, percent, crowd))
    release(spark)
    return merged(groups, in_turns(more))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = 85,
    width: int = 5,
    tables: int = 10,
    rows: int = 3,
    hot: int = 64,
    common_halves: int = 1 << 17,
    turns: int | None = None,
    turn_rows: int = 5_000_000,
    turn_shingles: int = 32_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked: ``100 * |A & B| >= percent * |A | B|`` over distinct ``width``-word
    shingles.  With the defaults a pair at exactly 0.85 is missed with probability
    1.4e-4, at 0.9 with 4e-6.

    Empty or null texts: no shingles, linked with nothing.  Rows that repeat a
    doc_id are one node.  Bucket rows and pairs that carry their sets are shuffled in ``turns`` parts, of which
    the disk holds one at a time; by default a part for each ``turn_rows`` bucket rows and one for each ``turn_shingles``
    of the different sets, up to five.  A null doc_id takes no part: component_id null, kept true.
    An empty table gives an empty result.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    notes = durable(signatures(base, "doc_id", "text", width, tables, rows))
    live = notes.where("n_shingles > 0 and doc_id is not null")
    least = F.min("doc_id").alias("rep"), F.min_by("halves", "doc_id").alias("halves"), F.max("n_shingles").alias("n")
    classes = durable(live.groupBy("d1", "d2").agg(*least))
    reps = classes.select("rep", "halves")
    common = _common_halves(reps, tables, common_halves)
    spark = docs.sparkSession
    if turns is None:
        different, size = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        deals, turns = _turns(different * tables**2, turn_rows), _turns(size, turn_shingles)
    else:
        deals = turns = max(1, turns)
    deals = min(deals, tables)
    stars = _in_turns(lambda turn: _stars(_bucket_rows(reps, tables, hot, common, range(turn, tables, deals))), deals, spark)
    if deals > 1:
        stars = durable(stars.groupBy("a", "b").agg(F.sum("hits").alias("hits")))
    ends = durable(_ends(stars, "rep"))
    sets = durable(_sets_of(base, "doc_id", "text", ends, width).distinct())
    release(spark)
    groups = _confirm(stars, sets, percent, turns=turns, nodes=ends.toDF("node"))
    known = classes.join(groups.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component")
    )
    known = durable(known)
    named = notes.join(known.hint("merge"), ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return named.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept."""
    marks = near_duplicates(docs, id_col, text_col, **options)
    out = marks.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(out, docs[id_col].cast("long") == out["_gone"], "left_anti")
