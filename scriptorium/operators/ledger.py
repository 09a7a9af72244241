"""The processing ledger: documents shredded into sources, units and issues, and rows held against the catalog."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import normalize
from ..functions.text import match_key

# The ledger's version and enumerations.
FORMAT = "reading-ledger/v1"
DONE = ("integrated", "verified")
CLEANUP = ("ready-for-cleanup", "raw-and-draft-cleaned")
PROCESSING = ("captured", "extracted", "integrated", "verified", "blocked", "retired")
CLEANUP_ALL = ("not-ready", "ready-for-cleanup", "raw-and-draft-cleaned", "not-applicable", "unknown")
CONFIDENCE = ("exact", "reviewed", "unresolved")
SOURCE_FIELDS = ("kind", "title", "canonical_key")
SOURCE_PATHS = ("official_root", "entry_path")
LEGACY_INPUTS = (("raw_paths", "raw"), ("draft_paths", "draft"))


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


# --- reading variants ----------------------------------------------------


def _member(item: Column, name: str) -> Column:
    """A member of an object as a variant; SQL null where it is absent, a JSON null stays a value."""
    return F.try_variant_get(item, f"$.{name}", "variant")


def _is(value: Column, *kinds: str) -> Column:
    """Whether a variant's stored type begins with one of the names; false for SQL null."""
    kind = F.schema_of_variant(value)
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(kind, F.lit(k)) for k in kinds]), F.lit(False))


def _text(item: Column, name: str, absent: str = "") -> Column:
    """A member that is a text, an absent one as ``absent``; null where it is something else."""
    member = _member(item, name)
    return F.when(member.isNull(), absent).when(_is(member, "STRING"), F.try_variant_get(item, f"$.{name}", "string"))


def _string(value: Column) -> Column:
    return F.when(_is(value, "STRING"), value.try_cast("string"))


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _relative(text: Column) -> Column:
    """A path inside the tree in its normal form; null for anything else."""
    raw = F.replace(text, F.lit("\\"), F.lit("/"))
    unsafe = raw.rlike(r"^(/|[A-Za-z]:)|^/*$") | F.array_contains(F.split(raw, "/"), "..")
    return F.when(~unsafe, normalize(F.btrim(raw, F.lit("/"))))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _list(value: Column, what: Column) -> Column:
    return F.when(what, value.try_cast("array<variant>"))


def _coded(*rules: Column) -> Column:
    """The (code, path) pairs of the rules that hold."""
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def _rule(test: Column, code: str, path: Column | None = None) -> Column:
    found = F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), (F.lit("") if path is None else path).alias("path"))
    return F.when(test, found)


# --- entries -------------------------------------------------------------

_RAW = "struct<ok: boolean, role: string, path: string, presence: string, sha256: string, extensions: variant>"


def _raw(ok: Column, role: Column, path: Column, presence: Column, sha: Column, extensions: Column) -> Column:
    names = ("ok", "role", "path", "presence", "sha256", "extensions")
    return F.struct(*(c.alias(n) for c, n in zip((ok, role, path, presence, sha, extensions), names)))


def _modern(item: Column) -> Column:
    return _raw(_is(item, "OBJECT"), *(_text(item, c) for c in ("role", "path", "presence", "sha256")), _member(item, "extensions"))


def _legacy(role: str):
    """An entry of a legacy list: a bare path, or an object whose role may be absent and whose presence is its state."""

    def entry(item: Column) -> Column:
        bare, none = _is(item, "STRING"), F.lit(None).cast("variant")
        own = F.coalesce(_member(item, "role").try_cast("string"), F.when(_member(item, "role").isNull(), role).otherwise("None"))
        return F.when(bare, _raw(bare, F.lit(role), _string(item), F.lit("present"), F.lit(""), none)).otherwise(
            _raw(_is(item, "OBJECT"), own, _text(item, "path"), _text(item, "state", "present"), _text(item, "sha256"), none)
        )

    return entry


def _shape(raw: Column, invalid: str) -> tuple[Column, Column]:
    """(code, path): the first rule that an entry breaks before its own fields are looked at."""
    path = _relative(raw["path"])
    code = (
        F.when(~raw["ok"], invalid).when(_blank(raw["role"]), "ledger_role_missing").when(_blank(raw["path"]), "ledger_path_missing").when(path.isNull(), "ledger_path_unsafe")
    )
    return code, path


def _input(raw: Column) -> Column:
    shape, path = _shape(raw, "ledger_path_invalid")
    code = (
        F.when(shape.isNotNull(), shape)
        .when(~F.coalesce(raw["presence"].isin("present", "removed", "unknown"), F.lit(False)), "ledger_presence_invalid")
        .when(~F.coalesce(raw["sha256"].rlike("^([0-9a-fA-F]{64})?$"), F.lit(False)), "ledger_hash_invalid")
    )
    return F.struct(
        code.alias("code"), code.isNull().alias("kept"), _strip(raw["role"]).alias("role"), F.when(shape.isNull(), path).alias("path"), raw["presence"].alias("presence"), F.lower(raw["sha256"]).alias("sha256")
    )


def _output(raw: Column) -> Column:
    """An entry whose extensions or note id are malformed is kept without an id."""
    shape, path = _shape(raw, "ledger_output_invalid")
    odd = raw["extensions"].isNotNull() & ~_is(raw["extensions"], "OBJECT")
    note = F.when(raw["extensions"].isNull() | odd, "").otherwise(_text(raw["extensions"], "note_id"))
    well = F.coalesce(note.rlike("^(note_[0-9a-f]{32})?$"), F.lit(False))
    code = F.when(shape.isNotNull(), shape).when(odd, "ledger_output_extensions_invalid").when(~well, "ledger_note_id_invalid")
    return F.struct(
        code.alias("code"), shape.isNull().alias("kept"), _strip(raw["role"]).alias("role"), F.when(shape.isNull(), path).alias("path"), F.when(well, note).otherwise("").alias("note_id")
    )


def _exploded(units: DataFrame, column: str, entry, missing: str, fields: tuple[str, ...]) -> DataFrame:
    value = F.try_parse_json(F.col(column).cast("string"))
    found = F.transform(_list(value, _is(value, "ARRAY")), lambda x: entry(_modern(x)))
    rows = units.select("unit_id", found.isNull().alias("odd"), F.posexplode_outer(found).alias("position", "e")).where("odd or position is not null")
    good = lambda c: F.when(F.col("e.kept"), F.col(f"e.{c}")) if c != "path" else F.col("e.path")
    return rows.select(
        "unit_id", "position", F.when(F.col("odd"), missing).otherwise(F.col("e.code")).alias("code"), F.coalesce("e.kept", F.lit(False)).alias("kept"), *(good(c).alias(c) for c in fields)
    )


def input_entries(units: DataFrame) -> DataFrame:
    """(unit_id, position, code, kept, role, path, presence, sha256) of ``units(unit_id, inputs)``, inputs a JSON array.

    code: the first rule that an entry breaks, null for none.  Only entries without a code are kept; one that fails by its
    presence or hash still names its path.  A text that is null or no array gives one row without a position; an empty array gives none.
    """
    return _exploded(units, "inputs", _input, "ledger_paths_not_array", ("role", "path", "presence", "sha256"))


def output_entries(units: DataFrame) -> DataFrame:
    """(unit_id, position, code, kept, role, path, note_id) of ``units(unit_id, outputs)``, outputs a JSON array.

    As ``input_entries``, but an entry whose extensions or note id are malformed is kept without an id.
    """
    return _exploded(units, "outputs", _output, "ledger_outputs_not_array", ("role", "path", "note_id"))


# --- documents -----------------------------------------------------------


@dataclass(frozen=True)
class Ledger:
    """``documents (ledger, revision)``, ``sources``, ``units`` and ``issues (ledger, severity, code, unit_id, path)``."""

    documents: DataFrame
    sources: DataFrame
    units: DataFrame
    issues: DataFrame


def revision(document: Column) -> Column:
    """``missing``, ``invalid:`` and the content's hash for what is no JSON object, else ``sha256:`` and the hash."""
    digest, root = F.sha2(document, 256), F.try_parse_json(document)
    return F.when(document.isNull(), "missing").when(_is(root, "OBJECT"), F.concat(F.lit("sha256:"), digest)).otherwise(F.concat(F.lit("invalid:"), digest))


def shred(documents: DataFrame, column: str = "document", key: str = "ledger") -> Ledger:
    """Ledgers, one in each row's text, as normal rows.

    Every member is judged by its stored JSON type.  A source with any bad field is dropped, a unit keeps its
    place with the bad field blanked, a bad input is dropped, a bad output only where its role or path is bad; each rule broken is an
    issue.  The legacy form (version 1, units in an array) becomes the same rows; there the statuses allowed are the document's own, and of units
    that share an id the first stays.  A null text is a missing ledger; one in which an object repeats a key is no valid JSON here.
    """
    root = F.try_parse_json(F.col(column).cast("string"))
    version = _member(root, "version")
    one = F.when(_is(version, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), version.try_cast("double") == 1.0)
    rows = documents.select(
        F.col(key).alias("ledger"), revision(F.col(column).cast("string")).alias("revision"), F.col(column).isNull().alias("gone"), F.when(_is(root, "OBJECT"), root).alias("root"),
        root.isNull().alias("odd"), F.coalesce(one, F.lit(False)).alias("legacy"),
    )
    rows = rows.withColumns({"sources": _member(F.col("root"), "sources"), "units": _member(F.col("root"), "units")})
    rows = rows.withColumn("listed", F.col("legacy") & _is(F.col("units"), "ARRAY"))
    there = rows.where("root is not null")
    old, new = there.where("listed"), there.where("not legacy")
    missing = lambda c, kind: F.col(c).isNotNull() & ~_is(F.col(c), kind)
    whole = F.concat(
        _coded(
            _rule(F.col("gone"), "ledger_missing"),
            _rule(~F.col("gone") & F.col("odd"), "ledger_invalid_json"),
            _rule(~F.col("odd") & F.col("root").isNull(), "ledger_invalid_root"),
            _rule(F.col("root").isNotNull() & ~F.col("listed") & missing("sources", "OBJECT"), "ledger_sources_not_object"),
            _rule(F.col("root").isNotNull() & ~F.col("legacy") & ~_text(F.col("root"), "schema_version").eqNullSafe(F.lit(FORMAT)), "ledger_version_invalid"),
            _rule(F.col("root").isNotNull() & ~F.col("legacy") & missing("units", "OBJECT"), "ledger_units_not_object"),
            _rule(F.col("legacy") & ~F.col("listed") & F.col("units").isNotNull(), "ledger_units_not_array"),
        ),
        F.when(F.col("listed") | (F.col("legacy") & F.col("units").isNull()), F.array(F.struct(F.lit("warning").alias("severity"), F.lit("ledger_legacy_format").alias("code"), F.lit("").alias("path")))).otherwise(
            F.array().cast("array<struct<severity: string, code: string, path: string>>")
        ),
    )
    issue = lambda df, codes, unit: df.select("ledger", unit.alias("unit_id"), F.explode(codes).alias("i")).select("ledger", "i.severity", "i.code", "unit_id", "i.path")
    sources, source_issues = _sources(there.where("not listed"))
    units, unit_issues = _units(new)
    legacy, legacy_issues = _legacy_units(old)
    named = old.select("ledger", F.explode(_list(F.col("units"), F.lit(True))).alias("u")).where(_is(F.col("u"), "OBJECT"))
    source_id = _strip(F.coalesce(_member(F.col("u"), "source_id").try_cast("string"), F.lit("")))
    made = named.select("ledger", source_id.alias("source_id")).where("source_id <> ''").distinct()
    none = F.lit(None).cast("string")
    made = made.select(
        "ledger", "source_id", F.lit("legacy").alias("kind"), F.col("source_id").alias("title"), F.col("source_id").alias("canonical_key"), _texts().alias("inbox_roots"), none.alias("official_root"), none.alias("entry_path")
    )
    issues = reduce(DataFrame.unionByName, [issue(rows, whole, F.lit("")), source_issues, unit_issues, legacy_issues])
    return Ledger(rows.select("ledger", "revision"), sources.unionByName(made), units.unionByName(legacy), issues)


def _issues_of(rows: DataFrame, codes: str, unit: str) -> DataFrame:
    return rows.select("ledger", F.col(unit).alias("unit_id"), F.explode(codes).alias("i")).select("ledger", "i.severity", "i.code", "unit_id", "i.path")


def _sources(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = documents.select("ledger", F.explode(F.when(_is(F.col("sources"), "OBJECT"), F.col("sources")).try_cast("map<string, variant>")).alias("source_id", "s"))
    s = F.col("s")
    sound = _is(s, "OBJECT") & (F.col("source_id") != "")
    fields = {c: _text(s, c) for c in SOURCE_FIELDS}
    roots = _member(s, "inbox_roots")
    listed = roots.isNull() | _is(roots, "ARRAY")
    paths = F.transform(F.coalesce(_list(roots, listed), F.array().cast("array<variant>")), lambda r: _relative(_string(r)))
    single = {c: _member(s, c) for c in SOURCE_PATHS}
    given = {c: v.isNotNull() & ~_is(v, "VOID") for c, v in single.items()}
    unsafe = F.transform(F.filter(paths, lambda p: p.isNull()), lambda _: _rule(F.lit(True), "ledger_path_unsafe"))
    broken = F.concat(
        _coded(*(_rule(_blank(v), "ledger_source_field_missing") for v in fields.values()), _rule(~listed, "ledger_source_roots_invalid")),
        unsafe,
        _coded(*(_rule(given[c] & _relative(_string(single[c])).isNull(), "ledger_path_unsafe") for c in SOURCE_PATHS)),
    )
    rows = named.select(
        "ledger", "source_id", *(_strip(v).alias(c) for c, v in fields.items()), paths.alias("inbox_roots"),
        *(F.when(given[c], _relative(_string(single[c]))).alias(c) for c in SOURCE_PATHS),
        F.when(sound, broken).otherwise(F.array(_rule(F.lit(True), "ledger_source_invalid"))).alias("codes"),
        F.when(sound, F.col("source_id")).otherwise("").alias("blamed"),
    )
    return rows.where(F.size("codes") == 0).drop("codes", "blamed"), _issues_of(rows, "codes", "blamed")


_UNIT = ("source_id", "kind", "scope", "processing_status", "cleanup_status", "basis", "confidence", "issues")


def _with_entries(rows: DataFrame, inputs: Column, outputs: Column, codes: Column) -> tuple[DataFrame, DataFrame]:
    """(units, issues) of rows with the unit's own fields and codes; entries are judged and kept in the row."""
    judged = rows.withColumns({"all_in": F.transform(inputs, _input), "all_out": F.transform(outputs, _output), "codes": codes})
    coded = lambda c: F.transform(F.filter(c, lambda e: e["code"].isNotNull()), lambda e: F.struct(F.lit("error").alias("severity"), e["code"].alias("code"), F.coalesce(e["path"], F.lit("")).alias("path")))
    kept = lambda c, names: F.transform(F.filter(c, lambda e: e["kept"]), lambda e: F.struct(*(e[n].alias(n) for n in names)))
    units = judged.select(
        "ledger", "unit_id", *_UNIT, kept("all_in", ("role", "path", "sha256", "presence")).alias("inputs"), kept("all_out", ("role", "path", "note_id")).alias("outputs")
    )
    return units, _issues_of(judged.withColumn("every", F.concat("codes", coded("all_in"), coded("all_out"))), "every", "unit_id")


def _units(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = documents.select("ledger", F.explode(F.when(_is(F.col("units"), "OBJECT"), F.col("units")).try_cast("map<string, variant>")).alias("unit_id", "u"))
    u = F.col("u")
    code = F.when(F.col("unit_id") == "", "ledger_unit_id_missing").when(~_is(u, "OBJECT"), "ledger_unit_invalid")
    bad = named.withColumn("code", code).where("code is not null").select("ledger", F.lit("error").alias("severity"), "code", F.lit("").alias("unit_id"), F.lit("").alias("path"))
    good = named.where(code.isNull())
    known = lambda c, allowed: F.coalesce(_text(u, c).isin(*allowed), F.lit(False))
    filled = lambda c: F.coalesce(_text(u, c) != "", F.lit(False))
    shaped = lambda v: v.isNull() | _is(v, "OBJECT")
    scope, origin = _member(u, "scope"), _member(u, "provenance")
    origin_ok = shaped(origin)
    basis, sure = _member(origin, "basis"), F.when(origin_ok, _text(origin, "confidence")).otherwise("")
    all_texts = lambda v: v.isNull() | (_is(v, "ARRAY") & ~F.exists(_list(v, _is(v, "ARRAY")), lambda x: ~_is(x, "STRING")))
    basis_ok = ~origin_ok | all_texts(basis)
    sure_ok = F.coalesce(F.when(origin.isNull() | ~origin_ok, "").otherwise(sure).isin(*CONFIDENCE), F.lit(False))
    own = _member(u, "issues")
    entries = {c: _member(u, c) for c in ("inputs", "outputs")}
    listed = {c: v.isNull() | _is(v, "ARRAY") for c, v in entries.items()}
    texts = lambda v, ok: F.coalesce(F.when(ok, v.try_cast("array<string>")), _texts())
    codes = _coded(
        _rule(~known("processing_status", PROCESSING), "ledger_status_unknown"),
        _rule(~known("cleanup_status", CLEANUP_ALL), "ledger_cleanup_status_unknown"),
        _rule(~filled("source_id"), "ledger_source_id_missing"),
        _rule(~filled("kind"), "ledger_kind_missing"),
        _rule(~shaped(scope), "ledger_scope_invalid"),
        _rule(~origin_ok, "ledger_provenance_invalid"),
        _rule(~basis_ok, "ledger_provenance_basis_invalid"),
        _rule(~sure_ok, "ledger_provenance_confidence_invalid"),
        _rule(~all_texts(own), "ledger_issues_invalid"),
        _rule(~listed["inputs"], "ledger_paths_not_array"),
        _rule(~listed["outputs"], "ledger_outputs_not_array"),
    )
    rows = good.select(
        "ledger", "unit_id", F.when(filled("source_id"), _text(u, "source_id")).otherwise("").alias("source_id"), F.when(filled("kind"), _text(u, "kind")).otherwise("").alias("kind"),
        F.when(scope.isNotNull() & shaped(scope), F.to_json(scope)).otherwise("{}").alias("scope"),
        F.when(known("processing_status", PROCESSING), _text(u, "processing_status")).otherwise("").alias("processing_status"),
        F.when(known("cleanup_status", CLEANUP_ALL), _text(u, "cleanup_status")).otherwise("").alias("cleanup_status"),
        texts(basis, origin_ok & all_texts(basis)).alias("basis"), F.when(sure_ok, sure).otherwise("").alias("confidence"), texts(own, all_texts(own)).alias("issues"), "u",
    )
    none = F.array().cast("array<variant>")
    arrays = [F.transform(F.coalesce(_list(entries[c], listed[c]), none), _modern) for c in ("inputs", "outputs")]
    units, issues = _with_entries(rows, *arrays, codes)
    return units, bad.unionByName(issues)


def _legacy_units(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    allowed = lambda c: F.when(_is(_member(F.col("root"), c), "ARRAY"), F.filter(F.transform(_member(F.col("root"), c).try_cast("array<variant>"), _string), lambda x: x.isNotNull()))
    listed = documents.select("ledger", allowed("allowed_statuses").alias("statuses"), allowed("allowed_cleanup_statuses").alias("cleanups"), F.posexplode(_list(F.col("units"), F.lit(True))).alias("at", "u"))
    u = F.col("u")
    own = listed.withColumn("unit_id", F.when(_is(u, "OBJECT"), _text(u, "unit_id")))
    turn = F.row_number().over(W.partitionBy("ledger", "unit_id").orderBy("at"))
    code = F.when(~_is(u, "OBJECT"), "ledger_unit_invalid").when(_blank(F.col("unit_id")) | (F.col("turn") > 1), "ledger_unit_id_invalid")
    judged = own.withColumn("turn", turn).withColumn("code", code)
    bad = judged.where("code is not null").select("ledger", F.lit("error").alias("severity"), "code", F.lit("").alias("unit_id"), F.lit("").alias("path"))
    known = lambda c, those: F.coalesce((_text(u, c) != "") & (F.col(those).isNull() | F.array_contains(those, _text(u, c))), F.lit(False))
    status, clean, source = known("processing_status", "statuses"), known("cleanup_status", "cleanups"), ~_blank(_text(u, "source_id"))
    lists = {c: _member(u, c) for c in ("raw_paths", "draft_paths", "official_paths")}
    good_list = {c: v.isNull() | _is(v, "ARRAY") for c, v in lists.items()}
    none = F.array().cast("array<variant>")
    entries = lambda c, role: F.transform(F.coalesce(_list(lists[c], good_list[c]), none), _legacy(role))
    codes = _coded(
        _rule(~source, "ledger_source_id_missing"),
        _rule(~status, "ledger_status_unknown"),
        _rule(~clean, "ledger_cleanup_status_unknown"),
        *(_rule(~good_list[c], "ledger_paths_not_array") for c, _ in LEGACY_INPUTS),
        _rule(~good_list["official_paths"], "ledger_outputs_not_array"),
    )
    rows = judged.where("code is null").select(
        "ledger", "unit_id", F.when(source, _text(u, "source_id")).otherwise("").alias("source_id"), F.lit("legacy").alias("kind"), F.lit("{}").alias("scope"),
        F.when(status, _text(u, "processing_status")).otherwise("").alias("processing_status"), F.when(clean, _text(u, "cleanup_status")).otherwise("").alias("cleanup_status"),
        _texts("legacy-ledger").alias("basis"), F.lit("unresolved").alias("confidence"), _texts().alias("issues"), "u", "statuses", "cleanups",
    )
    units, issues = _with_entries(rows, F.concat(*(entries(c, role) for c, role in LEGACY_INPUTS)), entries("official_paths", "official"), codes)
    return units, bad.unionByName(issues)


def read(document: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """(sources, units) from a column of ledger JSON, one ledger; an unreadable document gives none."""
    found = shred(document.withColumn("ledger", F.lit("")), column)
    return found.sources.drop("ledger"), found.units.drop("ledger")


# --- focus ---------------------------------------------------------------


def matching(ledger: Ledger, focus: DataFrame, identity: DataFrame) -> DataFrame:
    """(focus, ledger, unit_id): units that a focus touches through an input, a resolved output or a path of their source.

    ``focus (focus)`` has paths, matched without regard to case; one without a file suffix stands for all below it.  Every path a unit
    has is listed with the folders above it, so that the match is an equi join on those, not a comparison of all pairs.
    ``identity (id, path)`` says where a note with an id lies now.
    """
    key = lambda c: F.lower(c)
    units, sources = ledger.units, ledger.sources
    inputs = units.select("ledger", "unit_id", F.explode("inputs.path").alias("path"))
    made = units.select("ledger", "unit_id", F.explode("outputs").alias("o")).select("ledger", "unit_id", "o.path", F.col("o.note_id").alias("id"))
    resolved = made.where("id <> ''").join(identity.select("id", F.col("path").alias("now")), "id").select("ledger", "unit_id", F.col("now").alias("path"))
    roots = sources.select("ledger", "source_id", F.explode(F.concat("inbox_roots", F.array(*SOURCE_PATHS))).alias("path")).where("path <> ''")
    rooted = units.select("ledger", "unit_id", "source_id").join(roots, ["ledger", "source_id"]).select("ledger", "unit_id", "path")
    parts = [inputs, made.where("id = ''").select("ledger", "unit_id", "path"), resolved, rooted]
    paths = reduce(DataFrame.unionByName, parts).where("path <> ''")
    steps = F.split(key(F.col("path")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, 1, n), "/").alias("p"), (n == F.size(steps)).alias("self")))
    listed = paths.select("ledger", "unit_id", F.explode(prefixes).alias("x")).select("ledger", "unit_id", "x.p", "x.self")
    asked = focus.select("focus", key(F.col("focus")).alias("p"), (F.regexp_extract("focus", r"[^/](\.[^/.]+)$", 1) != "").alias("file"))
    met = listed.groupBy("ledger", "unit_id", "p").agg(F.max("self").alias("self")).join(asked, "p")
    return met.where("self or not file").select("focus", "ledger", "unit_id").distinct()


def named(units: DataFrame, query: str) -> DataFrame:
    """Units whose own or source's id contains the query, without regard to case."""
    wanted = match_key(F.lit(query))
    return units.where(F.contains(match_key(F.col("unit_id")), wanted) | F.contains(match_key(F.col("source_id")), wanted))


def cross_check(units: DataFrame, sources: DataFrame, notes: DataFrame, identity: DataFrame) -> DataFrame:
    """(severity, code, unit_id, path, target) of units that contradict the catalog.

    ``units(unit_id, source_id, processing_status, cleanup_status, inputs, outputs)`` with inputs
    (role, path, sha256, presence) and outputs (role, path, note_id); ``notes(path, sha256, id)``;
    ``identity(id, path)``.  Rules within a unit are projections; the others are equi joins.
    """
    listed = lambda c: F.coalesce(c, F.array().cast(units.schema[c].dataType))  # noqa: E731  an absent list is an empty one
    units = units.withColumns({"inputs": listed("inputs"), "outputs": listed("outputs")})
    official = F.exists("outputs", lambda o: o["role"] == "official")
    loose = F.filter("inputs", lambda i: i["role"].isin("raw", "draft"))
    unhashed = F.exists(loose, lambda i: ~i["presence"].isin("present", "removed") | (F.coalesce(i["sha256"], F.lit("")) == ""))
    done, cleaning = F.col("processing_status").isin(*DONE), F.col("cleanup_status").isin(*CLEANUP)
    rules: dict[str, Column] = {
        "ledger_integrated_without_output": done & ~official,
        "ledger_cleanup_without_raw_hash": cleaning & ((F.size(loose) == 0) | unhashed),
        "ledger_cleanup_before_integration": cleaning & ~done,
        "ledger_cleanup_without_output": cleaning & ~official,
        "ledger_cleaned_input_still_present": (F.col("cleanup_status") == "raw-and-draft-cleaned") & F.exists(loose, lambda i: i["presence"] != "removed"),
    }
    broken = F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda c: c.isNotNull())
    empty = F.lit("")
    inside = units.select("unit_id", F.explode(broken).alias("code")).select(F.lit("error").alias("severity"), "code", "unit_id", empty.alias("path"), empty.alias("target"))
    unknown = units.join(sources.select("source_id"), "source_id", "left_anti").select(
        F.lit("error").alias("severity"), F.lit("ledger_source_unknown").alias("code"), "unit_id", empty.alias("path"), empty.alias("target")
    )
    files = notes.select("path", F.col("sha256").alias("have"), F.col("id").alias("own_id"), F.lit(True).alias("there"))
    taken = units.select("unit_id", F.explode("inputs").alias("i")).select("unit_id", "i.path", F.coalesce("i.sha256", F.lit("")).alias("want"), "i.presence").join(files, "path", "left")
    there = F.col("there").isNotNull()
    code = (
        F.when((F.col("presence") == "present") & ~there, "ledger_path_missing")
        .when((F.col("presence") == "present") & (F.col("want") != "") & (F.coalesce("have", empty) == ""), "ledger_hash_unverifiable")
        .when((F.col("presence") == "present") & (F.col("want") != "") & (F.col("want") != F.col("have")), "ledger_hash_mismatch")
        .when((F.col("presence") == "removed") & there, "ledger_removed_path_exists")
    )
    soft = F.col("code").isin("ledger_hash_unverifiable", "ledger_removed_path_exists", "ledger_output_path_stale")
    severity = F.when(soft, "warning").otherwise("error").alias("severity")
    inputs = taken.withColumn("code", code).where("code is not null").select(severity, "code", "unit_id", "path", empty.alias("target"))
    made = units.select("unit_id", F.explode("outputs").alias("o")).select("unit_id", "o.path", F.coalesce("o.note_id", empty).alias("note_id"))
    made = made.join(files, "path", "left").join(identity.select(F.col("id").alias("note_id"), F.col("path").alias("now")), "note_id", "left")
    by_id = F.col("note_id") != ""
    code = (
        F.when(by_id & F.col("now").isNull(), "ledger_note_id_missing")
        .when(by_id & (F.col("path") != F.col("now")) & ~there, "ledger_output_path_stale")
        .when(by_id & (F.col("path") != F.col("now")) & (F.coalesce("own_id", empty) != F.col("note_id")), "ledger_output_identity_mismatch")
        .when(~by_id & ~there, "ledger_output_missing")
    )
    target = F.when(F.col("code") == "ledger_note_id_missing", F.col("note_id")).when(F.col("code") == "ledger_output_missing", empty).otherwise(F.col("now"))
    outputs = made.withColumn("code", code).where("code is not null").select(severity, "code", "unit_id", "path", target.alias("target"))
    return reduce(DataFrame.unionByName, [inside, unknown, inputs, outputs])
