"""Contiguous shards of near equal bytes, from global prefix sums.

Rows (narrow: id, size, checksum) are range-partitioned by id and sorted once,
and that is made durable.  Each partition reports its total; the running sum of
those few totals is where each partition starts.  Every partition then adds its
own running sum and cuts at equal targets: a row belongs to the shard that
holds its middle byte.  No task sees more than its own partition, and it holds
one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable

_PLACED = "doc_id long, size long, text_crc32 long, shard int, place long"


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size: UTF-8 bytes of the text plus 1 (null text: 1).  Shards are contiguous in
    (doc_id, checksum, size); null ids come last.  A shard's bytes miss the equal share
    by less than the largest row.  slot counts from 0 in each shard.  Rows that
    repeat an id, or are equal, keep a place each.  An empty table gives no rows;
    with fewer rows than shards some shards stay empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    rows = durable(narrow.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    totals = sorted(map(tuple, rows.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect()))
    begins, total, count = {}, 0, 0
    for part, size, n in totals:  # one entry for each partition, however many rows it has
        begins[part] = (total, count)
        total, count = total + size, count + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if byte is None:
                byte, place = begins[batch.column(3)[0].as_py()]
            size = batch.column(1).to_numpy(zero_copy_only=False)
            before = byte + np.cumsum(size) - size
            shard = np.minimum(shards - 1, (2 * before + size) * shards // (2 * total))
            yield pa.record_batch(
                [
                    *batch.columns[:3],
                    pa.array(shard.astype(np.int32)),
                    pa.array(place + np.arange(len(size), dtype=np.int64)),
                ],
                names=["doc_id", "size", "text_crc32", "shard", "place"],
            )
            byte, place = byte + int(size.sum()), place + len(size)

    placed = rows.mapInArrow(run, _PLACED)
    firsts = dict(map(tuple, placed.groupBy("shard").agg(F.min("place")).collect()))  # one entry for each shard
    first = F.lit(0).cast("long")
    for shard, place in sorted(firsts.items()):
        first = F.when(F.col("shard") == shard, F.lit(place)).otherwise(first)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
