"""Path functions as Columns; paths are relative and use ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^/.]+)$", 1)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"([^/])\.[^/.]+$", "$1")


def stem(path: Column) -> Column:
    return F.regexp_extract(without_suffix(path), r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(prefix: Column) -> Column:
    """How specific a prefix is: its number of parts, 0 for the whole tree."""
    return F.when(prefix.isin("", "."), 0).otherwise(F.size(F.split(prefix, "/")))


def under(path: Column, prefix: Column, *, fold: bool = False, dot: bool = True) -> Column:
    """Whether the path is the prefix or below it.  ``fold``: without regard to case;
    ``dot``: ``.`` stands for the whole tree, as the empty prefix does."""
    if fold:
        path, prefix = F.lower(path), F.lower(prefix)
    whole = prefix.isin("", ".") if dot else prefix == ""
    return whole | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def chunk_id(path: Column, index: Column) -> Column:
    """16 hex digits of the lower-cased path's SHA-1, ``::`` and the index in four digits or more."""
    number = F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))
    return F.concat(F.substring(F.sha1(F.lower(path)), 1, 16), F.lit("::"), number)


def ancestors(path: Column) -> Column:
    """The folders above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def guard(path: Column) -> Column:
    """True for a path that stays inside the tree: relative, no drive, no ``..``."""
    return (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
