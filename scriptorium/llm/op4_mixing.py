"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Blocks.  A hash of the id places every document of a source in one of the source's
blocks (about ``block_rows`` documents, at most ``most_blocks`` blocks a source),
so blocks are disjoint random sets and their order is a random permutation.

Quotas.  A source's target is filled by whole passes over its blocks and a last
pass over the first blocks, of which the last is cut to the word.  The number of
blocks drawn, pass by pass, is the source's exact quota.

Tree.  The root holds the quotas of all sources.  A node splits its vector between
its two halves of the output shards with one multivariate-hypergeometric draw;
the leaves are the shards.  Each shard takes its share of every source's permuted
blocks, disjoint from the others', and shuffles it locally by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import durable

WEIGHTS = (5, 2, 1)
_SPAN = 1 << 52
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    rows: int
    target: float
    passes: int  # whole passes over the source
    rest: int  # words that the last, partial pass takes


def targets(sizes: list[int], weights: list[int], share_percent: int = 150, most: int = 2) -> list[float]:
    """Words of each source: shares of ``share_percent`` % of all words by weight; a
    source above ``most`` times its size stops there and the excess is shared again."""
    total, capped = sum(sizes), [False] * len(sizes)
    while True:
        rest = (share_percent * total - 100 * most * sum(s for s, c in zip(sizes, capped) if c)) / 100
        weight = sum(w for w, c in zip(weights, capped) if not c)
        out = [float(most * s) if c else rest * w / weight for s, w, c in zip(sizes, weights, capped)]
        over = [c or t > most * s for s, t, c in zip(sizes, out, capped)]
        if over == capped:
            return out
        capped = over


def split_quotas(quotas: list[int], shards: int, seed: int = 17) -> np.ndarray:
    """(shards, sources): exact block counts, by recursive multivariate-hypergeometric draws."""
    total = sum(quotas)
    room = [total * (i + 1) // shards - total * i // shards for i in range(shards)]
    out = np.zeros((shards, len(quotas)), np.int64)

    def descend(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi])
        left = draw.multivariate_hypergeometric(have, sum(room[lo:mid]), method="marginals")
        descend(lo, mid, left)
        descend(mid, hi, have - left)

    if len(quotas):
        descend(0, shards, np.array(quotas, np.int64))
    return out


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number below 2**52 from a hash that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 13), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def sources_of(rows: DataFrame) -> list[Source]:
    """Sources by code point, null last; one row for each, made by a partial aggregate."""
    found = rows.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    found = sorted(map(tuple, found), key=lambda x: (x[0] is None, x[0] or ""))
    want = targets([x[1] for x in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]) if found else []
    out = []
    for (name, size, n), target in zip(found, want):
        words = min(round(target), 2 * size)
        passes = min(2, words // size) if size else 0
        out.append(Source(name, size, n, target, passes, words - passes * size))
    return out


def _dimension(spark: SparkSession, sources: list[Source], block_rows: int, most_blocks: int) -> DataFrame:
    rows = [
        ("0" if s.name is None else "1" + s.name, i, s.size, s.target, s.passes, s.rest, min(most_blocks, -(-s.rows // block_rows)))
        for i, s in enumerate(sources)
    ]
    return spark.createDataFrame(
        rows, "source_key string, source_at int, source_size long, target double, passes int, rest long, blocks long"
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    shards: int = 16,
    seed: int = 17,
    block_rows: int = 64,
    most_blocks: int = 4096,
    carry: Column | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws) for every row of ``docs``.

    ``carry`` is one more column of ``docs`` that each row takes along, as ``row``.

    taken: words that the mix takes of the row, repeats counted; a source's taken
    words are its target rounded.  draws: the output shard of each pass over the
    row's block, a partial last pass included.

    Null or empty texts: size 0, taken 0.  Null source: a source of its own.  A null
    id is hashed as an empty one.  Rows that repeat an id share a block; equal rows
    are told apart by nothing but their place, which changes no sum.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    kept = [] if carry is None else [carry.alias("row")]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        *kept,
    )
    rows = rows if kept else durable(rows)
    sources = sources_of(rows)
    dim = _dimension(spark, sources, block_rows, most_blocks)
    spot = _unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    placed = (
        rows.withColumn("source_key", _key(F.col("source")))
        .withColumn("spot", spot)
        .join(dim, "source_key")
        .withColumn("block", F.expr(f"cast(floor(cast(spot as double) * blocks / {_SPAN}) as long)"))
    )
    totals = placed.groupBy("source_at", "block").agg(
        F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")
    )
    blocks = durable(
        totals.withColumn("before", F.sum("words").over(W.partitionBy("source_at").orderBy("block")) - F.col("words"))
    )
    # The block instances that are drawn: every block in each whole pass, the first ones once more.
    partial = (F.col("before") < F.col("rest")).cast("int")
    drawn = blocks.withColumn("pass", F.explode(F.expr("sequence(1, 3)"))).where(F.col("pass") <= F.col("passes") + partial)
    quota = dict(map(tuple, drawn.groupBy("source_at").agg(F.count(F.lit(1))).collect()))
    shares = split_quotas([quota.get(i, 0) for i in range(len(sources))], shards, seed)
    ends = spark.createDataFrame(
        [(i, [int(x) for x in np.cumsum(shares[:, i])]) for i in range(len(sources))], "source_at int, ends array<long>"
    )
    shuffled = W.partitionBy("source_at").orderBy(_unit(F.lit(str(seed)), F.col("block"), F.col("pass")), "block", "pass")
    shares_of = (
        drawn.withColumn("rank", F.row_number().over(shuffled))
        .join(ends, "source_at")
        .withColumn("shard", F.expr("cast(size(filter(ends, e -> e < rank)) as int)"))
    )
    plan = durable(
        shares_of.groupBy("source_at", "block").agg(
            F.min("before").alias("before"),
            F.count(F.when(F.col("pass") <= F.col("passes"), 1)).alias("whole"),
            F.count(F.when(F.col("pass") > F.col("passes"), 1)).alias("part"),
            F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("draws"),
        )
    )
    inside = W.partitionBy("source_at", "block").orderBy("spot", "doc_id", "size")
    ranked = placed.withColumn("inner", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    joined = ranked.join(plan, ["source_at", "block"], "left")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inner")))
    taken = F.coalesce(F.col("whole") * F.col("size") + F.col("part") * last, F.lit(0)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *(["row"] if kept else []))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, spread: int = 1024, **options
) -> DataFrame:
    """``docs`` as the mix draws them: a row as often as its words are taken, in shuffled shards.

    Every row keeps its own share, rows of one id included.  A document that the mix takes only
    in part becomes its first words, one blank between them.  Rows are spread by output
    shard, each in up to ``spread`` parts, and inside a part ordered by a hash.

    Null and empty texts have no words and aren't taken.  A null source is a source of its
    own; null ids are taken like any other.  An empty table gives no rows.  Columns
    may have any names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    plan = mix(docs, id_col, text_col, source_col, carry=row, **options)
    pieces = F.expr(
        "transform(sequence(1, cast(ceil(taken / size) as int)),"
        " p -> struct(least(size, taken - (p - 1) * size) as words, draws[p - 1] as shard, p as pass))"
    )
    drawn = plan.where("taken > 0").select("doc_id", "size", "row", F.explode(pieces).alias("piece"))
    text = F.col("row").getField(text_col)
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lit(1), F.col("piece.words").cast("int")), " ")
    cut = F.when(F.col("piece.words") < F.col("size"), first_words).otherwise(text)
    order = _unit(F.lit("order"), F.col("piece.pass"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = drawn.select("row", F.col("piece.shard").alias("shard"), cut.alias("cut"), order.alias("order"))
    placed = placed.repartition("shard", F.expr(f"order % {int(spread)}")).sortWithinPartitions("shard", "order")
    return placed.select(*(F.col("cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
