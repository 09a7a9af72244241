"""The catalog's records: a listing, a content read of what changed, and a merge that keeps what can't be read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import vault
from ..storage import Buckets, written
from . import catalog as C
from .digests import canonical_sha256, tree_digest

# Fixed value: the records' version, part of the fingerprint.
VERSION = 1
_LINKS = "array<struct<target: string, heading: string, alias: string, display: string>>"
RECORD = (
    "path string, kind string, extension string, size long, modified timestamp, sha256 string, id string, identity_state string, title string, aliases array<string>,"
    f" type string, status string, metadata map<string,string>, outlinks {_LINKS}, embeds {_LINKS}, collections array<string>, primary_collection string"
)
_FIELDS = [c.split(" ")[0] for c in RECORD.replace(_LINKS, "x").split(", ")]
# The fields of a record that its structure's digest covers.
STRUCTURE = ("path", "id", "identity_state", "title", "aliases", "kind", "extension", "type", "status", "metadata", "collections", "primary_collection", "outlinks", "embeds")


@dataclass(frozen=True)
class Scope:
    """What the catalog covers and how records are made; another scope makes the catalog anew."""

    include: tuple[str, ...] = ("",)
    exclude: tuple[str, ...] = ()
    non_markdown: bool = False
    identity_paths: tuple[str, ...] = ("",)
    metadata_fields: tuple[str, ...] = ()
    collections: tuple[C.Collection, ...] = field(default=())
    buckets: int = 64

    def fingerprint(self) -> str:
        parts = {c.name: [c.paths, c.role, c.workflow, c.processor] for c in self.collections}
        listed = {k: getattr(self, k) for k in ("include", "exclude", "non_markdown", "identity_paths", "metadata_fields", "buckets")}
        return canonical_sha256({"version": VERSION, "collections": parts, **listed})


def store_of(spark: SparkSession, folder: str, scope: Scope) -> Buckets:
    return Buckets(spark, folder, RECORD, "path", scope.buckets)


def whitelisted(front_matter: Column, fields: tuple[str, ...]) -> Column:
    """The named front-matter fields that a note has, in the order named, lists joined."""
    pairs = [F.when(F.size(F.coalesce(front_matter[f], F.array().cast("array<string>"))) > 0, F.struct(F.lit(f).alias("k"), F.array_join(front_matter[f], ", ").alias("v"))) for f in dict.fromkeys(fields)]
    none = F.array().cast("array<struct<k: string, v: string>>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()) if pairs else none)


def records(files: DataFrame, scope: Scope) -> DataFrame:
    """Records of files (path, kind, extension, size, modified, content); notes that aren't UTF-8 give none."""
    text = F.col("content").cast("string")
    notes = files.where((F.col("kind") == "markdown") & F.is_valid_utf8(text))
    hashed = notes.select("path", "kind", "extension", "size", "modified", F.sha2("content", 256).alias("sha256"))
    parsed = vault.parse_notes(notes.select("path", vault.decode(F.col("content")).alias("text")))
    made = hashed.join(parsed.select("path", "id", "title", "aliases", "type", "status", whitelisted(F.col("frontmatter"), scope.metadata_fields).alias("metadata"), "outlinks", "embeds"), "path")
    links, empty = F.array().cast(_LINKS), F.lit("")
    other = files.where("kind <> 'markdown'").select(
        "path", "kind", "extension", "size", "modified", empty.alias("sha256"), empty.alias("id"), F.substring_index("path", "/", -1).alias("title"), F.array().cast("array<string>").alias("aliases"), empty.alias("type"),
        empty.alias("status"), F.expr("cast(map() as map<string, string>)").alias("metadata"), links.alias("outlinks"), links.alias("embeds"),
    )
    every = C.with_collections(made.unionByName(other), list(scope.collections))
    return every.withColumn("identity_state", C.identity_state(F.col("id"), F.col("path"))).select(*_FIELDS)


def sync_folder(spark: SparkSession, root: str, folder: str, scope: Scope = Scope(), **options) -> dict:
    """``sync`` of the files below ``root``.

    The paths of the files to open go through the driver, where Spark's own file index holds those of the whole listing.
    """
    listing = vault.listing(spark, root, scope.include, scope.exclude, scope.non_markdown)
    return sync(listing, lambda files: vault.contents(spark, [f for (f,) in files.collect()]), folder, scope, **options)


def sync(listing: DataFrame, read: Callable[[DataFrame], DataFrame], folder: str, scope: Scope = Scope(), *, verify: bool = False, dry_run: bool = False) -> dict:
    """Brings the catalog in ``folder`` to a ``listing (path, file, kind, extension, size, modified)``.

    First the listing alone is compared: a file whose size and time of change are those of its record isn't
    opened (with ``verify`` all are).  Then ``read`` gets the others' (file) and gives (file, content), and they are parsed.  A note that
    can't be read keeps its old record and is an error ``catalog_read_failed``; a file that is gone loses its record.  Only
    buckets with a changed record are rewritten.  ``dry_run`` counts and changes nothing.

    Returns scanned, files, changed, unchanged, deleted, errors, opened, possible_legacy_moves, reset, and the revision and
    content digest of the catalog.
    """
    spark = listing.sparkSession
    table = store_of(spark, folder, scope)
    known = table.manifest()
    reset = known is not None and known[2] != scope.fingerprint()
    number = known[0] + 1 if known else 0
    before = table.read(set() if reset or known is None else None)
    scratch = f"{folder}/scratch/{number}{'-dry' if dry_run else ''}"
    old = before.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.lit(True).alias("known"))
    met = listing.join(old, "path", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified")) & F.lit(not verify)
    state = F.when(F.col("size").isNull(), "deleted").when(F.col("known").isNull(), "new").when(same, "same").otherwise("read")
    states = written(met.select("path", "file", "kind", "extension", "size", "modified", state.alias("state")), f"{scratch}/states")
    opened = states.where("state in ('new', 'read')")
    notes = opened.where("kind = 'markdown'").select("file")
    made = written(records(opened.join(read(notes), "file", "left"), scope), f"{scratch}/records")
    row = F.struct(*_FIELDS)
    pairs = made.select("path", F.to_json(row).alias("now")).join(before.select("path", F.to_json(row).alias("was")), "path", "left")
    fresh = pairs.where(~F.col("now").eqNullSafe(F.col("was"))).select("path")
    failed = opened.join(made.select("path"), "path", "left_anti").select("path")
    gone = states.where("state = 'deleted'").select("path")
    replaced = written(fresh.union(gone), f"{scratch}/replaced")
    touched = {b for (b,) in replaced.select(table.bucket()).distinct().collect()}
    moved = C.legacy_moves(before.where("kind = 'markdown'"), made.union(before.join(replaced, "path", "left_anti").join(made.select("path"), "path", "left_anti")), scope.identity_paths).count() if known and not reset else 0
    counts = dict(map(tuple, states.groupBy("state").agg(F.count(F.lit(1))).collect()))
    changed, errors = fresh.count(), failed.count()
    if not dry_run:
        stays = before.where(table.bucket().isin(*touched) if touched else F.lit(False)).join(replaced, "path", "left_anti")
        table.write(stays.select(*_FIELDS).unionByName(made.join(fresh, "path")), touched, number, scope.fingerprint())
        after = table.read()
    else:
        after = before.join(replaced, "path", "left_anti").select(*_FIELDS).unionByName(made.join(fresh, "path").select(*_FIELDS))
    scanned = sum(n for s, n in counts.items() if s != "deleted")
    return {
        "scanned": scanned, "files": after.count(), "changed": changed, "unchanged": scanned - changed - errors, "deleted": counts.get("deleted", 0), "errors": errors, "opened": notes.count(),
        "possible_legacy_moves": moved, "reset": reset, "verify": verify, "dry_run": dry_run, "revision": revision(after, scope), "content_digest": content_digest(after),
    }


def failed_reads(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(severity, code, path, target) of the notes that a sync could not read."""
    states, read = (spark.read.parquet(f"{folder}/scratch/{number}/{x}") for x in ("states", "records"))
    lost = states.where("state in ('new', 'read')").join(read.select("path"), "path", "left_anti")
    return lost.select(F.lit("error").alias("severity"), F.lit("catalog_read_failed").alias("code"), "path", F.lit("").alias("target"))


# --- watermarks ----------------------------------------------------------


def identity_key(note_id: Column, path: Column) -> Column:
    """What a note is known by: its stable id, or else its path."""
    return F.when(C.identity_state(note_id, path) == "stable", note_id).otherwise(F.concat(F.lit("legacy-path:"), path))


def content_digest(notes: DataFrame) -> str:
    """Of every note's identity and content hash; moves of notes with ids leave it as it is."""
    markdown = F.lower(F.regexp_extract("path", r"[^/](\.[^/.]+)$", 1)) == ".md"
    return "sha256:" + tree_digest(notes.where(markdown).select(identity_key(F.col("id"), F.col("path")).alias("k"), "sha256"), "k", "sha256").first().digest


def revision(notes: DataFrame, scope: Scope) -> str:
    """Of the scope and of every record's structure; a note's prose leaves it as it is."""
    flat = notes.select(F.to_json(F.struct(*(F.col(c) for c in STRUCTURE if c in notes.columns))).alias("r"))
    return canonical_sha256({"scope": scope.fingerprint(), "files": tree_digest(flat, "r").first().digest})
