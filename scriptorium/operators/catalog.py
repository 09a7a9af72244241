"""The structural catalog: collections, lookup, links, identity, changes, issues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import fold_text, folded, match_key

STABLE = r"^note_[0-9a-f]{32}$"


@dataclass(frozen=True)
class Collection:
    """A configured part of the tree; the order of collections breaks ties."""

    name: str
    paths: tuple[str, ...]
    role: str = ""
    workflow: str = ""
    processor: str = ""
    entrypoints: tuple[str, ...] = ()
    related: tuple[str, ...] = field(default=())


# --- collections ---------------------------------------------------------


def _matches(path: Column, collections: list[Collection]) -> Column:
    """Array of (-depth, order, name) of the collections a path belongs to, best first."""
    found = []
    for order, c in enumerate(collections):
        hits = [F.when(P.under(path, F.lit(p), fold=True), F.lit(0 if p in ("", ".") else len(p.split("/")))) for p in c.paths]
        best = hits[0] if len(hits) == 1 else F.greatest(*hits)
        found.append(F.when(best.isNotNull(), F.struct((-best).alias("rank"), F.lit(order).alias("ord"), F.lit(c.name).alias("name"))))
    listed = F.array(*found).cast("array<struct<rank: int, ord: int, name: string>>")
    return F.array_sort(F.filter(listed, lambda x: x.isNotNull()))


def membership(notes: DataFrame, collections: list[Collection]) -> DataFrame:
    """(path, position, collection): position 0 is the primary collection.

    A collection's depth is that of its deepest matching prefix; prefixes match without
    regard to case.  Collections are configuration, so this is a projection, not a join.
    """
    found = notes.select("path", F.posexplode(F.transform(_matches(F.col("path"), collections), lambda x: x["name"])).alias("position", "collection"))
    return found


def with_collections(notes: DataFrame, collections: list[Collection]) -> DataFrame:
    names = F.transform(_matches(F.col("path"), collections), lambda x: x["name"])
    return notes.withColumn("collections", names).withColumn("primary_collection", F.coalesce(F.get("collections", F.lit(0)), F.lit("")))


def collection_summary(members: DataFrame) -> DataFrame:
    """(collection, files, markdown, other_files)."""
    markdown = F.count_if(F.lower(P.suffix(F.col("path"))) == ".md")
    return members.groupBy("collection").agg(F.count(F.lit(1)).alias("files"), markdown.alias("markdown"), (F.count(F.lit(1)) - markdown).alias("other_files"))


def child_counts(notes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(name, files): files by their first part below the deepest prefix they are under."""
    rest = F.lit(None).cast("string")
    for p in sorted(prefixes, key=lambda x: 0 if x in ("", ".") else len(x.split("/"))):  # the deepest is tried first
        below = F.col("path") if p in ("", ".") else F.ltrim(F.expr(f"substring(path, {len(p) + 1})"), F.lit("/"))
        rest = F.when(P.under(F.col("path"), F.lit(p), fold=True), below).otherwise(rest)
    child = F.substring_index(rest, "/", 1)
    return notes.select(child.alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("files"))


def related(members: DataFrame, collections: list[Collection]) -> DataFrame:
    """(path, collection): one step along ``related``, without collections the file is in."""
    pairs = members.sparkSession.createDataFrame([(c.name, r) for c in collections for r in c.related], "collection string, related string")
    reached = members.join(F.broadcast(pairs), "collection").select("path", F.col("related").alias("collection")).distinct()  # configuration: a row for each link
    return reached.join(members.select("path", "collection"), ["path", "collection"], "left_anti")


def readmes_above(notes: DataFrame, name: str = "README.md") -> DataFrame:
    """(path, depth, readme): the cataloged README files of the folders on the way to each note.

    Depth 1 is the top folder; the root's own file is none of them, a README's own path is.
    """
    above = notes.select("path", F.explode(P.ancestors(F.col("path"))).alias("folder")).where("folder <> ''")
    made = above.select("path", F.size(F.split("folder", "/")).alias("depth"), F.concat("folder", F.lit("/" + name)).alias("readme"))
    return made.join(notes.select(F.col("path").alias("readme")).distinct(), "readme", "left_semi").select("path", "depth", "readme")


# --- lookup and links ----------------------------------------------------


def lookup(notes: DataFrame) -> DataFrame:
    """(key, path): every name a note answers to, folded for any script."""
    p = F.col("path")
    names = F.concat(F.array(p, P.without_suffix(p), P.stem(p), F.coalesce("id", F.lit("")), F.coalesce("title", F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = folded(notes.select("path", names.alias("names")), "names")
    return keys.select("path", F.explode(F.array_distinct("names")).alias("key")).where("key <> ''").select("key", "path")


def ambiguous_names(notes: DataFrame) -> DataFrame:
    """(key, paths): keys that more than one note answers to."""
    return lookup(notes).groupBy("key").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1")


def link_names(path: Column, target: Column) -> Column:
    """The names a link may be found under; an empty target is the note itself."""
    clean = F.btrim(F.replace(target, F.lit("\\"), F.lit("/")), F.lit(" /"))
    bare = F.when(F.lower(P.suffix(clean)) == ".md", P.without_suffix(clean)).otherwise(clean)
    folder = P.parent(path)
    beside = F.when(folder == "", bare).otherwise(F.concat(folder, F.lit("/"), bare))
    return F.when(clean == "", F.array(path)).when(F.instr(clean, "/") > 0, F.array(bare, beside)).otherwise(F.array(bare))


def edges(notes: DataFrame) -> DataFrame:
    """(path, ord, target, key): an outgoing link for each key it may resolve under, folded for any script."""
    out = notes.select("path", F.posexplode("outlinks").alias("ord", "target"))
    keys = folded(out.select("path", "ord", "target", link_names(F.col("path"), F.col("target")).alias("keys")), "keys")
    return keys.select("path", "ord", "target", F.explode(F.array_distinct("keys")).alias("key"))


def resolve_links(notes: DataFrame) -> DataFrame:
    """(path, ord, target, status, resolved): unresolved, unique or ambiguous, and the first path.

    Names are reduced to their first and last path before the join, so a name that
    very many notes share costs one row, not one for every note and link.
    """
    names = lookup(notes).groupBy("key").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    met = edges(notes).join(names, "key", "left").groupBy("path", "ord", "target").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    status = F.when(F.col("first").isNull(), "unresolved").when(F.col("first") == F.col("last"), "unique").otherwise("ambiguous")
    return met.select("path", "ord", "target", status.alias("status"), F.coalesce("first", F.lit("")).alias("resolved"))


def embed_issues(notes: DataFrame, non_markdown: bool = False) -> DataFrame:
    """(severity, code, path, target) of embeds that resolve to nothing or to several notes.

    An embed of a file that is no note is looked at only where the catalog holds such files (``non_markdown``); an empty
    target and a null list are none.
    """
    listed = F.coalesce("embeds", F.array().cast("array<string>"))
    kind = lambda t: F.lower(P.suffix(t))
    wanted = F.filter(listed, lambda t: (t != "") & (F.lit(non_markdown) | kind(t).isin("", ".md")))
    broken = resolve_links(notes.withColumn("outlinks", wanted)).where("status <> 'unique'")
    return broken.select(F.lit("warning").alias("severity"), F.concat("status", F.lit("_wikilink")).alias("code"), "path", "target")


def backlinks(notes: DataFrame, crowd: int = 16) -> DataFrame:
    """(path, backlinks): in how many notes a link resolves to the path.

    Links meet notes one by one only under names of at most ``crowd`` notes.  The notes that link to a more common name are
    counted once for each set of such names that some note answers to; of the links under other names those
    count that come from a note not counted so.
    """
    ends = edges(notes).select(F.col("path").alias("source"), "key").distinct()
    names = lookup(notes).distinct()
    linked = ends.groupBy("key").agg(F.count(F.lit(1)).alias("sources"))
    common = names.groupBy("key").agg(F.count(F.lit(1)).alias("notes")).where(F.col("notes") > crowd).join(linked, "key").select("key", "sources")
    pairs = ends.join(common, "key", "left_anti").join(names, "key").select("source", "path").distinct()
    shared = names.join(common, "key").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key", "sources"))).alias("shared"))
    own = pairs.join(shared, "path", "left").select("source", "path", F.explode_outer("shared.key").alias("key"))
    met = own.join(ends.withColumn("counted", F.lit(True)), ["source", "key"], "left").groupBy("source", "path").agg(F.max("counted").alias("counted"))
    single = met.where("counted is null").groupBy("path").agg(F.count(F.lit(1)).alias("single"))
    sets = shared.where(F.size("shared") > 1).select(F.col("shared.key").alias("keys")).distinct()
    several = sets.select("keys", F.explode("keys").alias("key")).join(ends, "key").select("keys", "source").distinct().groupBy("keys").agg(F.count(F.lit(1)).alias("several"))
    totals = shared.select("path", F.col("shared.key").alias("keys"), F.get("shared", F.lit(0))["sources"].alias("sources")).join(several, "keys", "left")
    both = totals.select("path", F.coalesce("several", "sources").alias("total")).join(single, "path", "full_outer")
    return both.select("path", (F.coalesce("total", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("backlinks"))


def link_counts(notes: DataFrame, most: int = 1000) -> DataFrame:
    """(path, outlinks, embeds, backlinks) of every note; backlinks are reported up to ``most``.

    Notes are counted where ``embeds`` is absent as having none.
    """
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) if c in notes.columns else F.lit(0)
    own = notes.select("path", size("outlinks").alias("outlinks"), size("embeds").alias("embeds"))
    return own.join(backlinks(notes), "path", "left").select("path", "outlinks", "embeds", F.least(F.coalesce("backlinks", F.lit(0)), F.lit(most)).alias("backlinks"))


# --- finding -------------------------------------------------------------


def _with_keys(notes: DataFrame) -> DataFrame:
    """path and ``keys``: the folded path, path without suffix, stem, title, id and aliases."""
    p, none = F.col("path"), F.array().cast("array<string>")
    names = F.concat(F.array(p, P.without_suffix(p), P.stem(p), F.col("title"), F.col("id")), F.coalesce("aliases", none))
    return folded(notes.select("path", names.alias("keys")), "keys")


def match_score(query: str, exact: bool = False) -> Column:
    """Tier of a note (its ``keys``) for a query: 110 to 60, or null."""
    q, q_path = F.lit(fold_text(query)), F.lit(fold_text(query.replace("\\", "/").strip("/")))
    key = lambda i: F.get("keys", F.lit(i))
    aliases = F.slice("keys", F.lit(6), F.size("keys"))
    tier = (
        F.when((key(4) != "") & (key(4) == q), 110)
        .when((key(0) == q_path) | (key(1) == q_path), 100)
        .when(key(3) == q, 98)
        .when(F.array_contains(aliases, q), 97)
        .when(key(2) == q, 96)
    )
    names = F.concat(F.slice("keys", F.lit(1), F.lit(4)), aliases)
    return tier if exact else tier.when(F.exists(names, lambda v: F.startswith(v, q)), 80).when(F.exists(names, lambda v: F.contains(v, q)), 60)


def find(notes: DataFrame, queries: list[str], exact: bool = False) -> DataFrame:
    """(query, path, score) of all matches; in exact mode only each query's best tier.

    Names and queries are folded for any script.  The stated queries are literals of one pass over the catalog.
    """
    if not all(q.strip() for q in queries):
        raise ValueError("a query must not be empty")
    tried = [F.struct(F.lit(q).alias("query"), match_score(q, exact).alias("score")) for q in queries]
    hits = _with_keys(notes).select("path", F.explode(F.filter(F.array(*tried), lambda x: x["score"].isNotNull())).alias("m")).select("m.query", "path", "m.score")
    if exact:
        best = hits.groupBy("query").agg(F.max("score").alias("score"))
        hits = hits.join(F.broadcast(best), ["query", "score"])  # a row for each stated query
    return hits.select("query", "path", "score")


def within(notes: DataFrame, collections: list[Collection], collection: str = "", under: str = "", note_type: str = "") -> DataFrame:
    """Notes of a collection, below a prefix and of a type; an empty filter lets all pass.

    The collection's name and the prefix keep their case, the type's doesn't count.
    """
    kept = notes
    if collection:
        kept = kept.where(F.array_contains(F.transform(_matches(F.col("path"), collections), lambda x: x["name"]), collection))
    if under:
        kept = kept.where(P.under(F.col("path"), F.lit(under)))
    if note_type:
        kept = kept.where(match_key(F.coalesce("type", F.lit(""))) == match_key(F.lit(note_type)))
    return kept


def find_page(notes: DataFrame, query: str, limit: int = 20, exact: bool = False) -> DataFrame:
    """(position, path, score, total): a page of at most 24 matches, best first, with the exact total."""
    hits = find(notes, [query], exact)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = hits.orderBy(F.col("score").desc(), F.lower("path"), "path").limit(min(limit, 24))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.lower("path"), "path")
    return page.withColumn("position", F.row_number().over(order)).withColumn("total", total.scalar()).select("position", "path", "score", "total")


def resolve(notes: DataFrame, paths: list[str]) -> DataFrame:
    """(asked, status, path): paths without regard to case, ``.md`` implied."""
    hits = notes.select("path", F.explode(F.filter(F.array(*map(F.lit, paths)), lambda q: F.lower("path").isin(F.lower(q), F.concat(F.lower(q), F.lit(".md"))))).alias("asked"))
    found = hits.groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    asked = notes.sparkSession.createDataFrame([(p,) for p in paths], "asked string")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return asked.join(found, "asked", "left").select("asked", status.alias("status"), F.when(F.col("n") == 1, F.col("path")).otherwise("").alias("path"))


def find_pages(notes: DataFrame, queries: list[str], limit: int = 20, exact: bool = False) -> DataFrame:
    """(query, status, total, truncated, position, path, score): a page of at most 24 matches of every query, best first.

    status: ``matches``; in exact mode, where only the best tier counts, ``unique`` or ``ambiguous``; ``not_found`` with one
    row without a path.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    most, hits = min(limit, 24), find(notes, list(dict.fromkeys(queries)), exact)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.lower("path"), "path")
    page = hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    totals = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    asked = notes.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string")
    total = F.coalesce("n", F.lit(0))
    status = F.when(total == 0, "not_found").when(F.lit(not exact), "matches").when(total == 1, "unique").otherwise("ambiguous")
    found = asked.join(totals, "query", "left").join(page, "query", "left")
    return found.select("query", status.alias("status"), total.alias("total"), (total > most).alias("truncated"), "position", "path", "score")


def resolve_targets(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, status, match_type, path, other, matches) of ``asked (asked, id, path)``, id or path null where it isn't given.

    An id is met folded, a path without regard to case, ``.md`` implied where it has no suffix.  Given both, they must agree: one note
    each, but not the same, is ``id_path_conflict`` (path and other are the two); only one of them found is
    ``not_found``.  matches counts the notes met; path is the first of them unless nothing is unique.
    """
    if not asked.where("coalesce(id, path) is null").isEmpty():
        raise ValueError("each row needs an id or a path")
    own = folded(notes.select("path", F.array("id").alias("k")), "k").select("path", F.get("k", F.lit(0)).alias("key")).where("key <> ''")
    by_id = own.groupBy("key").agg(F.count(F.lit(1)).alias("id_n"), F.min("path").alias("id_path"))
    by_path = notes.select("path", F.lower("path").alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("found"))
    keyed = folded(asked.withColumn("k", F.array("id")), "k").withColumn("key", F.get("k", F.lit(0)))
    low = F.lower(P.normalize(F.btrim(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("/"))))
    names = F.when(P.suffix(low) == "", F.array(low, F.concat(low, F.lit(".md")))).otherwise(F.array(low))
    paths = asked.where("path is not null").select("asked", F.explode(names).alias("low")).join(by_path, "low").groupBy("asked").agg(F.sum("n").alias("path_n"), F.min("found").alias("path_path"))
    met = keyed.join(by_id, "key", "left").join(paths, "asked", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("id_n", "path_n")})
    both, with_id = F.col("id").isNotNull() & F.col("path").isNotNull(), F.col("id").isNotNull()
    ids, places = F.when(with_id, F.col("id_n")).otherwise(0), F.col("path_n")
    n, first = F.when(with_id, F.col("id_n")).otherwise(F.col("path_n")), F.when(with_id, F.col("id_path")).otherwise(F.col("path_path"))
    apart = (ids == 1) & (places == 1) & (F.col("id_path") != F.col("path_path"))
    status = (
        F.when(both & ((ids > 1) | (places > 1)), "ambiguous").when(both & apart, "id_path_conflict").when(both & (ids == 1) & (places == 1), "unique").when(both, "not_found")
        .when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("not_found")
    )
    kind = F.when(both, "stable_id_and_path").when(with_id, "stable_id").otherwise("path")
    found = met.withColumn("status", status)
    unique, conflict = F.col("status") == "unique", F.col("status") == "id_path_conflict"
    return found.select(
        "asked", "status", F.when(unique, kind).alias("match_type"), F.when(conflict, F.col("id_path")).when(unique, first).alias("path"), F.when(conflict, F.col("path_path")).alias("other"),
        F.when(F.col("status") == "not_found", 0).otherwise(F.when(both, F.greatest(ids, places)).otherwise(n)).cast("long").alias("matches"),
    )


# --- identity ------------------------------------------------------------


def identity_state(note_id: Column, path: Column) -> Column:
    markdown = F.lower(P.suffix(path)) == ".md"
    return F.when(~markdown, "not-applicable").when(F.coalesce(note_id, F.lit("")) == "", "legacy").when(note_id.rlike(STABLE), "stable").otherwise("malformed")


def identity_summary(notes: DataFrame) -> DataFrame:
    return notes.groupBy(identity_state(F.col("id"), F.col("path")).alias("state")).agg(F.count(F.lit(1)).alias("files"))


def managed(path: Column, identity_paths: tuple[str, ...]) -> Column:
    """Whether a path lies where notes must have stable ids."""
    out = F.lit(False)
    for p in identity_paths:
        out = out | P.under(path, F.lit(p), fold=True)
    return out


def identity_totals(notes: DataFrame, identity_paths: tuple[str, ...] = ("",)) -> DataFrame:
    """One row (stable, legacy, malformed, managed_legacy), zeros included."""
    state = identity_state(F.col("id"), F.col("path"))
    counted = {s: state == s for s in ("stable", "legacy", "malformed")}
    counted["managed_legacy"] = (state == "legacy") & managed(F.col("path"), identity_paths)
    return notes.agg(*(F.count(F.when(test, 1)).alias(name) for name, test in counted.items()))


def identity_index(notes: DataFrame) -> DataFrame:
    """(id, path) of stable ids that exactly one note carries."""
    stable = notes.where(identity_state(F.col("id"), F.col("path")) == "stable")
    return stable.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1").select("id", "path")


def duplicate_ids(notes: DataFrame) -> DataFrame:
    """(id, files, first_path) of stable ids that several notes carry."""
    stable = notes.where(identity_state(F.col("id"), F.col("path")) == "stable")
    return stable.groupBy("id").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")).where("files > 1")


# --- changes -------------------------------------------------------------


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, deleted, changed or unchanged, by content hash."""
    both = old.select("path", F.col("sha256").alias("was")).join(new.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def possible_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, new_path): a deleted and an added file with the same content, both alone with it."""
    gone = old.join(new.select("path"), "path", "left_anti").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("old_path")).where("n = 1")
    come = new.join(old.select("path"), "path", "left_anti").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("new_path")).where("n = 1")
    return gone.select("sha256", "old_path").join(come.select("sha256", "new_path"), "sha256").select("old_path", "new_path")


def legacy_moves(old: DataFrame, new: DataFrame, identity_paths: tuple[str, ...] = ("",)) -> DataFrame:
    """(old_path, new_path) of possible moves among managed notes without ids (path, id, sha256)."""
    loose = lambda df: df.where((identity_state(F.col("id"), F.col("path")) == "legacy") & managed(F.col("path"), identity_paths) & (F.col("sha256") != ""))
    gone = loose(old).join(new.select("path"), "path", "left_anti").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("old_path")).where("n = 1")
    come = loose(new).join(old.select("path"), "path", "left_anti").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("new_path")).where("n = 1")
    return gone.select("sha256", "old_path").join(come.select("sha256", "new_path"), "sha256").select("old_path", "new_path")


def chunk_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(chunk_id, problem): chunks that are missing, and chunks nothing asks for."""
    lost = expected.select("chunk_id").join(actual.select("chunk_id"), "chunk_id", "left_anti").withColumn("problem", F.lit("missing"))
    stray = actual.select("chunk_id").join(expected.select("chunk_id"), "chunk_id", "left_anti").withColumn("problem", F.lit("orphaned"))
    return lost.union(stray)


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """(digest): SHA-256 over the rows' own digests in order, so equal sets of rows agree.

    Rows are reduced by a hash prefix first; at most 4,096 digests meet at the end.
    """
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    lots = rows.select(one.alias("h")).groupBy(F.substring("h", 1, 3).alias("lot")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return lots.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lot", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


# --- issues --------------------------------------------------------------


def issues(notes: DataFrame, collections: list[Collection], identity_paths: tuple[str, ...] = ("",), non_markdown: bool = False) -> DataFrame:
    """(severity, code, path, target): identity, registry and graph problems of a catalog."""
    state = identity_state(F.col("id"), F.col("path"))
    managed = F.lit(False)
    for p in identity_paths:
        managed = managed | P.under(F.col("path"), F.lit(p), fold=True)

    def rows(df: DataFrame, severity: str, code: str, path: str = "path", target: str | None = None) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(path).alias("path"), (F.col(target) if target else F.lit("")).alias("target"))

    links = resolve_links(notes)
    files = notes.select("path")
    folders = notes.select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()
    there = files.union(folders)
    spark = notes.sparkSession
    wanted = spark.createDataFrame([(p,) for c in collections for p in c.paths if p not in ("", ".")], "path string")
    entry = spark.createDataFrame([(p,) for c in collections for p in c.entrypoints], "path string")
    loose = with_collections(notes, collections).where(F.size("collections") == 0).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 0")
    found = [
        rows(notes.where(state == "malformed"), "error", "malformed_note_id", target="id"),
        rows(duplicate_ids(notes), "error", "duplicate_note_id", "first_path", "id"),
        rows(notes.where((state == "legacy") & managed), "warning", "missing_stable_id"),
        rows(ambiguous_names(notes), "warning", "ambiguous_name", "key"),
        rows(links.where("status = 'unresolved'"), "warning", "unresolved_wikilink", target="target"),
        rows(links.where("status = 'ambiguous'"), "warning", "ambiguous_wikilink", target="target"),
        rows(wanted.join(there, "path", "left_anti"), "error", "collection_path_missing"),
        rows(entry.join(files, "path", "left_anti"), "error", "collection_entrypoint_missing"),
        rows(loose, "warning", "unclassified_files"),
        *([embed_issues(notes, non_markdown)] if "embeds" in notes.columns else []),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def issue_bag(notes: DataFrame, collections: list[Collection], identity_paths: tuple[str, ...] = ("",), more: DataFrame | None = None) -> DataFrame:
    """All issues with ``more`` of them (of a scan, a ledger); notes without ids are one issue, at the first path."""
    found = issues(notes, collections, identity_paths)
    missing = found.where("code = 'missing_stable_id'").agg(F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct(F.lower("path"), "path")).alias("path"))
    first = missing.where("n > 0").select(F.lit("warning").alias("severity"), F.lit("missing_stable_id").alias("code"), "path", F.lit("").alias("target"))
    out = found.where("code <> 'missing_stable_id'").unionByName(first)
    return out if more is None else out.unionByName(more.select("severity", "code", "path", "target"))


def issue_totals(found: DataFrame) -> DataFrame:
    """One row (errors, warnings) of issues."""
    return found.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"))


def warning_codes(found: DataFrame) -> DataFrame:
    """(code) of all warnings, each once."""
    return found.where("severity = 'warning'").select("code").distinct()


def in_order(found: DataFrame) -> DataFrame:
    """Issues by severity, code, path and target, the last two without regard to case first."""
    return found.orderBy("severity", "code", F.lower("path"), "path", F.lower("target"), "target")
