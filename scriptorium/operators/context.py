"""Context of foci: for many paths, queries and collections at once, bounded sections of what lies around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import folded, match_key
from ..storage import written
from . import catalog as C
from . import ledger as L

# The most items of a section, and of names of collections.
MOST, MOST_NAMES = 24, 64


def resolve_focus(foci: DataFrame, notes: DataFrame) -> DataFrame:
    """(focus, value, path, candidates): the note that a path names, as it stands, with ``.md``, or by a name only one note has.

    Without one, path is null: a directory, or nothing.  candidates counts the notes that share the name.
    """
    asked = foci.where("kind = 'path'").select("focus", "value")
    as_is = asked.join(notes.select("path"), F.col("value") == F.col("path")).select("focus", "path", F.lit(0).alias("turn"))
    suffixed = asked.join(notes.select("path"), F.concat("value", F.lit(".md")) == F.col("path")).select("focus", "path", F.lit(1).alias("turn"))
    names = C.lookup(notes).groupBy("key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    named = folded(asked.withColumn("keys", F.array("value")), "keys").select("focus", F.get("keys", F.lit(0)).alias("key")).join(names, "key")
    unique = named.where("n = 1").select("focus", "path", F.lit(2).alias("turn"))
    best = as_is.union(suffixed).union(unique).groupBy("focus").agg(F.min(F.struct("turn", "path")).alias("b"))
    found = asked.join(best, "focus", "left").join(named.select("focus", "n"), "focus", "left")
    return found.select("focus", "value", F.col("b.path").alias("path"), F.when(F.col("b").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).alias("candidates"))


def _section(rows: DataFrame, name: str, item: Column, *order: Column) -> DataFrame:
    """(focus, section, key, item); key orders the items."""
    parts = [o.cast("string") for o in order]
    return rows.select("focus", F.lit(name).alias("section"), F.array(*parts).alias("key"), item.alias("item"))


def _number(n: Column) -> Column:
    return F.lpad(n.cast("string"), 19, "0")


def _names(rows: DataFrame) -> DataFrame:
    """The first place of every name of a focus."""
    return rows.groupBy("focus", "name").agg(F.min("at").alias("at"))


def sections(
    foci: DataFrame, notes: DataFrame, collections: list[C.Collection], ledger: L.Ledger, folder: str, *, limit: int = 12
) -> DataFrame:
    """(focus, section, position, item, total, truncated) for ``foci (focus, kind, value)``, kind path, query or collection.

    A note's outlinks, embeds, backlinks and siblings; a directory's children with their numbers of files; a query's matches; the
    collections matched and, one step on, related; the ledger's units and sources that a path touches or a query names; issues
    of a focus that is ambiguous or found nowhere.  A section has at most ``limit`` items (64 names), best first, and
    its total.

    All sections are one tagged union, cut by one ranked window.  Siblings are the first of their folder, found once for
    each folder, so that a large folder is not joined to every focus in it.  Queries and collections are a stated set.  What several
    sections need is written to ``folder`` once; ``ledger`` is best read from tables, too.
    """
    spark = notes.sparkSession
    most = min(limit, MOST)
    found = written(resolve_focus(foci, notes), f"{folder}/foci")
    aimed = found.where("path is not null").select("focus", "path")
    loose = found.where("path is null").select("focus", F.btrim("value", F.lit("/")).alias("folder"), "candidates")
    queries = [(f, v) for f, v in foci.where("kind = 'query'").select("focus", "value").collect()]

    own = aimed.join(notes, "path")
    out = own.select("focus", F.posexplode("outlinks").alias("at", "item"))
    parts = [_section(out, "outlinks", F.col("item"), _number(F.col("at")))]
    if "embeds" in notes.columns:
        parts.append(_section(own.select("focus", F.posexplode("embeds").alias("at", "item")), "embeds", F.col("item"), _number(F.col("at"))))
    keys = C.lookup(notes).join(aimed, "path").select("focus", "key")
    back = C.edges(notes).select(F.col("path").alias("item"), "key").join(keys, "key").select("focus", "item").distinct()
    parts.append(_section(back, "backlinks", F.col("item"), F.lower("item"), F.col("item")))
    placed = notes.select("path", P.parent(F.col("path")).alias("folder"))
    wanted = aimed.select("focus", "path", P.parent(F.col("path")).alias("folder"))
    turn = F.row_number().over(W.partitionBy("folder").orderBy(F.lower("path"), "path"))
    first = placed.withColumn("turn", turn).where(F.col("turn") <= most + 1).select("folder", F.col("path").alias("item"))
    beside = wanted.join(first, "folder").where("item <> path")
    parts.append(_section(beside, "siblings", F.col("item"), F.lower("item"), F.col("item")))
    sizes = placed.groupBy("folder").agg((F.count(F.lit(1)) - 1).alias("more"))
    sibling_totals = wanted.join(sizes, "folder").select("focus", F.lit("siblings").alias("section"), "more")

    above = notes.select("path", F.explode(P.ancestors(F.col("path"))).alias("folder"))
    below = loose.join(above, "folder")
    rest = F.expr("substring(path, length(folder) + if(folder = '', 1, 2))")
    children = below.select("focus", F.substring_index(rest, "/", 1).alias("name")).groupBy("focus", "name").agg(F.count(F.lit(1)).alias("files"))
    parts.append(_section(children, "children", F.concat_ws(":", "name", "files"), F.lower("name"), F.col("name")))
    empty = loose.join(below.select("focus").distinct(), "focus", "left_anti")
    issues = loose.where("candidates > 1").select("focus", F.lit("focus_ambiguous").alias("code")).union(empty.select("focus", F.lit("focus_not_found").alias("code")))
    parts.append(_section(issues, "focus_issues", F.col("code"), F.col("code")))

    named = C.find(notes, sorted({q for _, q in queries})) if queries else spark.createDataFrame([], "query string, path string, score int")
    asked = foci.where("kind = 'query'").select("focus", F.col("value").alias("query"))
    hits = written(asked.join(named, "query"), f"{folder}/hits")
    rank = (_number(1000 - F.col("score")), F.lower("path"), F.col("path"))
    parts.append(_section(hits, "matches", F.col("path"), *rank))

    touched = L.matching(ledger, found.select(F.coalesce("path", "value").alias("focus")).distinct(), C.identity_index(notes))
    by_path = found.select("focus", F.coalesce("path", "value").alias("p")).join(touched.withColumnRenamed("focus", "p"), "p").select("focus", "ledger", "unit_id")
    tests = [F.when(F.contains(match_key(F.col("unit_id")), match_key(F.lit(q))) | F.contains(match_key(F.col("source_id")), match_key(F.lit(q))), F.lit(f)) for f, q in queries]
    units = by_path
    if tests:
        units = units.union(ledger.units.select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("focus"), "ledger", "unit_id"))
    units = written(units.distinct(), f"{folder}/touched")
    label = F.concat_ws("/", "ledger", "unit_id")
    parts.append(_section(units, "reading_units", label, F.lower(label), label))
    sources = units.join(ledger.units.select("ledger", "unit_id", "source_id"), ["ledger", "unit_id"]).select("focus", "ledger", "source_id").distinct()
    sources = written(sources.join(ledger.sources, ["ledger", "source_id"]), f"{folder}/sourced")
    label = F.concat_ws("/", "ledger", "source_id")
    parts.append(_section(sources, "reading_sources", label, F.lower(label), label))

    rooted = sources.where("entry_path is not null or official_root is not null")
    of = lambda df, path: C.with_collections(df.withColumn("path", path), collections)
    best = W.partitionBy("focus").orderBy(F.col("score").desc(), F.lower("path"), "path")
    page = hits.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= most)
    steps = lambda df, *at: df.select("focus", F.posexplode("collections").alias("j", "name"), *at)
    matched = [
        steps(of(aimed, F.col("path"))).select("focus", "name", F.concat(F.lit("0"), _number(F.col("j"))).alias("at")),
        steps(of(loose, F.col("folder"))).select("focus", "name", F.concat(F.lit("0"), _number(F.col("j"))).alias("at")),
        steps(of(page, F.col("path")), "turn").select("focus", "name", F.concat(F.lit("1"), _number(F.col("turn")), _number(F.col("j"))).alias("at")),
        foci.where("kind = 'collection'").select("focus", F.col("value").alias("name"), F.lit("0").alias("at")),
        steps(of(rooted, F.coalesce("entry_path", "official_root"))).select("focus", "name", F.concat(F.lit("2"), _number(F.col("j"))).alias("at")),
    ]
    matched = written(_names(reduce(DataFrame.union, matched)), f"{folder}/matched")
    parts.append(_section(matched, "matched_collections", F.col("name"), F.col("at"), F.col("name")))
    pairs = [(c.name, r, i) for c in collections for i, r in enumerate(c.related)]
    hints = spark.createDataFrame(pairs, "name string, related string, i int")
    reached = matched.join(F.broadcast(hints), "name").select("focus", F.col("related").alias("name"), F.concat("at", _number(F.col("i"))).alias("at"))  # configuration
    related = _names(reached).join(matched.select("focus", "name"), ["focus", "name"], "left_anti")
    parts.append(_section(related, "related_collections", F.col("name"), F.col("at"), F.col("name")))

    every = written(reduce(DataFrame.unionByName, parts), f"{folder}/sections")
    totals = every.groupBy("focus", "section").agg(F.count(F.lit(1)).alias("n")).join(sibling_totals, ["focus", "section"], "left")
    turn = F.row_number().over(W.partitionBy("focus", "section").orderBy("key"))
    allowed = F.when(F.col("section").endswith("_collections"), MOST_NAMES).otherwise(most)
    kept = every.withColumn("position", turn).where(F.col("position") <= allowed)
    counted = kept.join(totals, ["focus", "section"]).withColumn("total", F.coalesce("more", "n"))
    return counted.select("focus", "section", "position", "item", "total", (F.col("total") > allowed).alias("truncated"))


# --- budgets -------------------------------------------------------------

# The sections of a route in the order in which they are filled, and the room kept.
ROUTE = ("reading_units", "matched_collections", "related_collections", "reading_sources", "matches", "focus_issues", "children", "outlinks", "backlinks", "embeds", "siblings")
SLACK = 16


def filled(items: Column, base: Column, budget: int, slack: int = SLACK) -> Column:
    """Which of ``items (section, chars, total)``, in their order, fit into ``budget`` characters of which ``base`` are used: array of booleans.

    A section stops at its first item that doesn't fit, the next one goes on.  An item costs its characters, a comma after the
    first of its section, and what the section's count of omitted items (total less taken) changes in length.
    """
    digits = lambda n: F.length(n.cast("string"))
    start = F.struct(base.cast("long").alias("used"), F.lit(-1).alias("section"), F.lit(0).cast("long").alias("taken"), F.lit(False).alias("stopped"), F.array().cast("array<boolean>").alias("fits"))

    def step(s: Column, x: Column) -> Column:
        same = s["section"] == x["section"]
        taken = F.when(same, s["taken"]).otherwise(F.lit(0).cast("long"))
        left = x["total"] - taken
        after = s["used"] + x["chars"] + F.when(taken > 0, 1).otherwise(0) + digits(left - 1) - digits(left)
        fits = ~(same & s["stopped"]) & (after + slack <= budget)
        return F.struct(
            F.when(fits, after).otherwise(s["used"]).alias("used"), x["section"].alias("section"), (taken + fits.cast("long")).alias("taken"), (~fits).alias("stopped"), F.concat(s["fits"], F.array(fits)).alias("fits")
        )

    return F.aggregate(items, start, step)


def routes(context: DataFrame, budget: int = 6000, least: int = 2000) -> DataFrame:
    """(focus, used_chars, truncated, capsule): each focus's sections as compact JSON within ``budget`` characters.

    The capsule has the sections of ``ROUTE`` and ``omitted``, how many items of each aren't shown.  A focus has a bounded number of
    items (``sections``), which one fold in its row fills in.
    """
    if budget < least:
        raise ValueError(f"the budget must be at least {least} characters")
    order = F.create_map(*[x for i, s in enumerate(ROUTE) for x in (F.lit(s), F.lit(i))])
    text = F.regexp_replace(F.to_json(F.array("item")), r"^\[|\]$", "")
    rows = context.withColumn("s", F.try_element_at(order, F.col("section"))).where("s is not null").withColumn("json", text)
    item = F.struct("s", "position", F.length("json").alias("chars"), F.col("total").cast("long").alias("total"), "json")
    one = rows.groupBy("focus").agg(F.array_sort(F.collect_list(item)).alias("items"), F.collect_set(F.struct("s", F.col("total").cast("long").alias("total"))).alias("totals"))
    known = F.map_from_entries("totals")
    count = lambda i: F.coalesce(F.try_element_at(known, F.lit(i)), F.lit(0).cast("long"))
    names = sorted(range(len(ROUTE)), key=lambda i: ROUTE[i])
    omitted = lambda taken: F.concat(F.lit('{'), F.concat_ws(",", *(F.concat(F.lit(f'"{ROUTE[i]}":'), (count(i) - taken(i)).cast("string")) for i in names)), F.lit("}"))
    fields = sorted([*ROUTE, "omitted"])

    def layout(shown, taken) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{f}":'), omitted(taken) if f == "omitted" else F.concat(F.lit("["), shown(ROUTE.index(f)), F.lit("]"))) for f in fields)), F.lit("}"))

    zero = lambda _: F.lit(0).cast("long")
    based = one.withColumn("base", F.length(layout(lambda _: F.lit(""), zero)))
    sized = F.transform("items", lambda x: F.struct(x["s"].alias("section"), x["chars"].cast("long").alias("chars"), x["total"].alias("total")))
    done = based.withColumn("fill", filled(sized, F.col("base"), budget))
    shown = done.withColumn("shown", F.filter(F.zip_with("items", F.col("fill.fits"), lambda x, f: F.when(f, x)), lambda x: x.isNotNull()))
    of = lambda i: F.filter("shown", lambda x: x["s"] == i)
    capsule = layout(lambda i: F.array_join(F.transform(of(i), lambda x: x["json"]), ","), lambda i: F.size(of(i)).cast("long"))
    cut = F.exists("totals", lambda t: t["total"] > F.size(F.filter("shown", lambda x: x["s"] == t["s"])))
    return shown.select("focus", F.col("fill.used").alias("used_chars"), cut.alias("truncated"), capsule.alias("capsule"))
