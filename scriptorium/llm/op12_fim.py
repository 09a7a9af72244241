"""Fill-in-the-middle: texts cut into prefix, middle and suffix and laid out anew.

A text is a sequence of units, the matches of a pattern from left to right.  An Arrow-batched pandas
UDF collects the units' end offsets in a compact array (four bytes a unit); hashes of the document's id choose
two of them, and two lookups there slice the text.  A second UDF rebuilds texts from what the first made.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The marks before prefix, suffix and middle, and the unit of the layout's first use.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
_CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


@functools.lru_cache(8)
def _pattern(unit: str):
    return regex.compile(unit)


def unit_ends(text: str, unit: str) -> array:
    """Where each unit ends, from left to right; what no unit matches goes with the unit after it."""
    return array("I", map(regex.Match.end, _pattern(unit).finditer(text, concurrent=False)))


def seeds(key: str, seed: int) -> list[int]:
    """Four numbers below 2**32 from the seed and a document's key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(text: str, key: str, unit: str, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and of middle, the text laid out)."""
    ends = unit_ends(text, unit)
    n = len(ends)
    a, b, form, order = seeds(key, seed)
    if not text or form % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    x, y = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if order % 100 < spm_below:
        return n, "spm", x, y - x, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", x, y - x, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that was laid out.  It held no mark, so that each mark's first place is its own."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    first, second = head.split(PREFIX if form == "spm" else SUFFIX, 1)
    first = first[len(SUFFIX if form == "spm" else PREFIX) :]
    return second + middle + first if form == "spm" else first + middle + second


def fim_column(unit: str = CODE_POINT, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> Callable[[Column, Column], Column]:
    """(key, text) -> struct of n, form, prefix_chars, middle_chars, output."""

    @F.pandas_udf(_CUT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            rows = [cut(t, k, unit, seed, 100 - plain_percent, spm_percent) for k, t in zip(keys, texts)]
            found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield found.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64", "form": object, "output": object})

    return run


@F.pandas_udf(StringType())
def restored(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    """The text that each layout was made of."""
    return pd.Series([rebuilt(o, f) for o, f in zip(outputs, forms)], dtype=object)


@F.pandas_udf(StringType())
def sha256(texts: pd.Series) -> pd.Series:
    """Lower-case hex digests of the texts' UTF-8."""
    return pd.Series([hashlib.sha256(t.encode()).hexdigest() for t in texts], dtype=object)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    n: units of the text.  The prefix ends after the smaller of two numbers of units drawn by hash, the middle after the larger.  form: plain
    (the text as it is), psm or spm; prefix_chars and middle_chars are code points, null if plain.  ``options`` are those of ``fim_column``.

    A null text is empty; an empty one is plain, as is one that holds a mark.  A null id is hashed as an empty one.  Rows that repeat an id are
    cut by the same seeds, equal rows alike.  Texts of any length are cut whole; a worker holds one batch of texts and the offsets of one.  An
    empty table gives no rows.
    """
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), fim_column(**options)(key, text).alias("cut"))
    return found.select("doc_id", "cut.*")
