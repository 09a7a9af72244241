"""Text functions as Columns: tokens, keys, hashing, front matter, links."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DIMENSIONS = 384
# The token pattern and the range of ideographs.
TOKEN = r"[a-zA-Z0-9_]+|[\x{4e00}-\x{9fff}]"
IDEOGRAPH = r"^[\x{4e00}-\x{9fff}]$"


def tokens(text: Column) -> Column:
    """Lower-cased words and single ideographs, then the bigrams of successive ideographs.

    Bigrams pair ideographs even where words stand between them.  Null text: none.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))

    def with_bigrams(all_: Column) -> Column:
        single = F.filter(all_, lambda t: t.rlike(IDEOGRAPH))
        pairs = F.transform(F.slice(single, 1, F.greatest(F.size(single) - 1, F.lit(0))), lambda t, i: F.concat(t, F.get(single, i + 1)))
        return F.when(F.size(single) < 2, all_).otherwise(F.concat(all_, pairs))

    return F.transform(F.array(found), with_bigrams)[0]


def match_key(text: Column) -> Column:
    """Lower case, blanks collapsed: the lookup key of ASCII texts (``folded`` is for any)."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def fold_text(text: str | None) -> str:
    """The lookup key for any script: NFKC, case folding, blanks collapsed; null is empty."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


@F.pandas_udf(StringType())
def fold_key(text):
    """``fold_text`` as a column."""
    return text.map(fold_text, na_action=None)


def folded(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the texts of an array column as their lookup keys.

    Rows of ASCII texts stay in the JVM; only the others take an Arrow pass.  Null texts are empty keys, a null
    array an empty one.
    """
    given = rows.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    plain = F.array_join(column, "").rlike(r"^\p{ASCII}*$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.names.index(column)
            keys = [[fold_text(t) for t in texts] for texts in batch.column(i).to_pylist()]
            yield batch.set_column(i, column, pa.array(keys, pa.list_(pa.string())))

    native = given.where(plain).withColumn(column, F.transform(column, match_key))
    return native.unionByName(given.where(~plain).mapInArrow(run, given.schema))


def hash_dimension(token: Column) -> Column:
    """First four bytes of the token's SHA-256, little-endian, modulo the dimensions."""
    h = F.sha2(token, 256)
    turned = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return (F.conv(turned, 16, 10).cast("long") % DIMENSIONS).cast("int")


def hash_sign(token: Column) -> Column:
    """-1 where the fifth byte of the token's SHA-256 is odd, else 1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 1, -1).otherwise(1)


def front_matter(raw: Column) -> Column:
    """Scalar fields of a leading ``---`` block as a map; none: an empty map.

    Flat ``key: value`` lines only; the last of repeated keys wins.  Lists and nested
    blocks are for ``sources.vault.parse_notes``.
    """
    block = F.regexp_extract(raw, r"^---\n([\s\S]*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^#\s-][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("k"), F.btrim(F.regexp_extract(x, r"^[^:]*:([\s\S]*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def list_items(value: Column) -> Column:
    """Items of an inline ``[a, b]`` list."""
    inner = F.btrim(F.regexp_extract(value, r"^\[([\s\S]*)\]$", 1))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.btrim(x)))


def links(body: Column) -> Column:
    """``[[target#heading|alias]]`` of a text without fences or comments, embeds flagged."""
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"!?\[\[[^\]]+\]\]"), F.lit(0))

    def split(x: Column) -> Column:
        inner = F.regexp_extract(x, r"\[\[([^\]]+)\]\]", 1)
        front = F.substring_index(inner, "|", 1)
        target = F.btrim(F.substring_index(front, "#", 1))
        heading = F.btrim(F.when(F.instr(front, "#") > 0, F.regexp_extract(front, r"#([\s\S]*)$", 1)).otherwise(""))
        alias = F.btrim(F.when(F.instr(inner, "|") > 0, F.regexp_extract(inner, r"\|([\s\S]*)$", 1)).otherwise(""))
        return F.struct(x.startswith("!").alias("embed"), target.alias("target"), heading.alias("heading"), alias.alias("alias"))

    return F.transform(raw, split)
