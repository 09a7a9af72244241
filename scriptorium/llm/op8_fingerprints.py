"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once.  The top bits of a hash choose its bin, and
each bin keeps its least hash.  An empty bin borrows from another by optimal
densification: it probes bins in an order of its own (a function of the bin's
number and the attempt alone) until one was filled by the document itself.  The
fingerprint stores the low ``BITS`` bits of every bin, packed as hex.  Unequal values
agree in their low bits by chance, so likeness is corrected for that:
``(m - c) / (1 - c)`` with ``m`` the share of equal bins and ``c = 2 ** -BITS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import durable

BINS, BITS, WIDTH = 256, 8, 5
_BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once for a row."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the word shingles; a shorter text's words are one shingle."""
    words = let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")),
    )
    one = F.transform(words, lambda w: F.xxhash64(w))
    rolled = let(
        one,
        lambda h: F.when(F.size(h) == 0, h)
        .when(F.size(h) < WIDTH, F.array(F.aggregate(h, F.size(h).cast("long"), lambda a, x: F.xxhash64(a, x))))
        .otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))
        ),
    )
    return F.sort_array(rolled)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BINS.bit_length() + 1).cast("int")


def packed_bins(hashes: Column) -> Column:
    """Low bits of every bin as array<tinyint>, from sorted shingle hashes; empty stays empty."""
    # Bound by let: a filter on the result may pull this expression into itself, and the
    # hashes must not be worked out again for every element then.
    least = let(hashes, lambda h: F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))))

    def dense(mins: Column) -> Column:
        places = F.transform(mins, _bin)
        own = let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(mins, F.array_position(p, b).cast("int") - 1)))

        def probe(bins: Column, b: Column, tries: Column) -> Column:
            # An odd stride visits all bins; both start and stride hang on the bin alone.
            start, stride = F.pmod(F.xxhash64(b), F.lit(BINS)), F.pmod(F.xxhash64(b, F.lit(1)), F.lit(BINS // 2)) * 2 + 1
            return let(
                F.struct(start.alias("s"), stride.alias("d")),
                lambda o: F.aggregate(
                    F.sequence(F.lit(1), tries),
                    F.lit(None).cast("long"),
                    lambda found, t: F.coalesce(found, F.get(bins, F.pmod(o["s"] + o["d"] * t, F.lit(BINS)).cast("int"))),
                ),
            )

        usual = F.least(F.lit(BINS), F.ceil(F.lit(8.0 * BINS) / F.size(mins)).cast("int"))
        low = lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        return let(
            own,
            lambda bins: F.transform(
                bins, lambda v, b: (low(F.coalesce(v, probe(bins, b, usual), probe(bins, b, F.lit(BINS)))) - (1 << (BITS - 1))).cast("tinyint")
            ),
        )

    return let(least, lambda mins: F.when(F.size(mins) == 0, F.array().cast("array<tinyint>")).otherwise(dense(mins)))


def to_hex(packed: Column) -> Column:
    digits = F.split(F.lit(" ".join(f"{i:02x}" for i in range(1 << BITS))), " ")
    return F.array_join(let(digits, lambda d: F.transform(packed, lambda v: F.get(d, v.cast("int") + (1 << (BITS - 1))))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprints, corrected for chance; two empty ones: 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    raw = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(F.greatest(F.lit(0.0), raw))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, packed) for every row; null text: an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingle_hashes(text).alias("hashes"))
    return hashed.select("doc_id", packed_bins(F.col("hashes")).alias("packed")).select("doc_id", to_hex(F.col("packed")).alias("fingerprint"), "packed")


def _with_next(rows: DataFrame, ids: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``next_text`` and ``next_packed``: those of the next row in descending doc_id.

    Rows fall into buckets by quantiles of doc_id (found by binary search).  The first
    row of each bucket is copied behind the bucket before it, so one window by
    bucket finds every successor; no bucket holds more than its share of ids.
    Rows without an id come last, in buckets by a hash of their text.
    """
    count = ids.agg(F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    buckets = max(1, min(1 << 16, -(-count.n // bucket_rows)))
    if count.n:
        quantiles = [i / buckets for i in range(1, buckets)] or [0.0]
        bounds = durable(ids.select(F.percentile_approx("doc_id", quantiles, max(10_000, 4 * buckets)).alias("bounds")))
    else:
        bounds = ids.sparkSession.sql("select array(0L) as bounds")
    steps = [1 << k for k in reversed(range(buckets.bit_length()))]

    def placed(df: DataFrame, spot: Column) -> DataFrame:
        known = df.withColumn("bounds", bounds.scalar())
        search = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda lo, s: F.when((lo + s <= F.size("bounds")) & (F.get("bounds", lo + s - 1) <= F.col("doc_id")), lo + s).otherwise(lo),
        )
        lost = (F.lit(-1) - F.shiftrightunsigned(spot, 58)).cast("int")
        return known.withColumn("bucket", F.when(F.col("doc_id").isNull(), lost).otherwise(search)).drop("bounds")

    firsts = placed(ids.where("doc_id is not null"), F.lit(0).cast("long")).groupBy("bucket").agg(F.max("doc_id").alias("lead"))
    if count["all"] > count.n:
        spots = rows.where("doc_id is null").select("doc_id", F.xxhash64("text").alias("spot"))
        firsts = firsts.union(placed(spots, F.col("spot")).groupBy("bucket").agg(F.min("spot")))
    table = sorted(map(tuple, firsts.collect()), reverse=True)  # at most 2**16 + 64 rows
    before = [(b, lead, table[i - 1][0]) for i, (b, lead) in enumerate(table)]
    ghosts = rows.sparkSession.createDataFrame(before, "bucket int, lead long, to int")
    spotted = placed(rows.withColumn("spot", F.xxhash64("text")), F.col("spot"))
    marked = spotted.join(F.broadcast(ghosts), "bucket", "left")
    here = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("to").alias("b"), F.lit(True).alias("ghost"))
    doubled = marked.withColumn(
        "at", F.explode(F.when(F.coalesce("doc_id", "spot") == F.col("lead"), F.array(here, there)).otherwise(F.array(here)))
    )
    flow = W.partitionBy("at.b").orderBy("at.ghost", F.col("doc_id").desc_nulls_last(), "spot")
    paired = doubled.withColumns({"next_text": F.lead("text").over(flow), "next_packed": F.lead("packed").over(flow)})
    return paired.where("not at.ghost").select("doc_id", "text", "packed", "next_text", "next_packed")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket_rows: int = 512) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, by descending doc_id, the last
    followed by the first.  Null text: empty.  Null ids come last, by a hash of their
    text; rows that share an id are ordered by that hash.  A single row is its own next.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    own = base.select("doc_id", "text", shingle_hashes(F.col("text")).alias("hashes")).select(
        "doc_id", "text", packed_bins(F.col("hashes")).alias("packed")
    )
    paired = _with_next(own, base.select("doc_id"), bucket_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    changed = paired.select("doc_id", "n_chars", "packed", "next_packed", edited.alias("edited"))
    hashed = changed.select(
        "doc_id", "n_chars", "packed", "next_packed", F.sha2("edited", 256).alias("edited_sha256"), shingle_hashes(F.col("edited")).alias("hashes")
    )
    both = hashed.select("doc_id", "n_chars", "edited_sha256", "packed", "next_packed", packed_bins(F.col("hashes")).alias("edited_packed"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_hex(F.col("packed")).alias("fingerprint"),
        to_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
