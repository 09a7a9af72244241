"""The catalog's two-phase sync over files: what is opened, what is kept, what is rewritten."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import catalog as C
from scriptorium.operators import catalog_sync as CS

SCOPE = CS.Scope(collections=(C.Collection("notes", ("Notes",)),), metadata_fields=("status", "project"), buckets=4, non_markdown=True, exclude=("skip",))


def put(root, path, text, at=1_700_000_000):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(full, (at, at))


@pytest.fixture
def root(tmp_path):
    for i in range(9):
        put(tmp_path / "vault", f"Notes/n{i}.md", f"---\ntitle: N{i}\nproject: [a, b]\n---\nsee [[n{i + 1}]]")
    put(tmp_path / "vault", "pic.png", b"\xff\x00")
    put(tmp_path / "vault", "skip/x.md", "x")
    return tmp_path / "vault"


def test_sync_of_files(spark, tmp_path, root):
    folder = f"{tmp_path}/catalog"
    rows = lambda: {r.path: r for r in CS.store_of(spark, folder, SCOPE).read().collect()}
    plan = CS.sync_folder(spark, str(root), folder, SCOPE, dry_run=True)
    assert plan["changed"] == 10 and CS.store_of(spark, folder, SCOPE).manifest() is None
    first = CS.sync_folder(spark, str(root), folder, SCOPE)
    assert (first["scanned"], first["changed"], first["opened"], first["errors"]) == (10, 10, 9, 0)
    assert rows()["Notes/n3.md"].metadata == {"project": "a, b"} and rows()["Notes/n3.md"].collections == ["notes"] and rows()["pic.png"].identity_state == "not-applicable"
    again = CS.sync_folder(spark, str(root), folder, SCOPE)
    assert (again["changed"], again["opened"], again["unchanged"], again["revision"]) == (0, 0, 10, first["revision"])
    kept = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/data/**/*.parquet", recursive=True)}
    put(root, "Notes/n0.md", "---\ntitle: N0\nproject: [c, d]\n---\nsee [[n1]]")  # same size and time: not opened
    put(root, "Notes/n1.md", "new text", 1_800_000_000)
    put(root, "Notes/n2.md", b"\xff\xfe broken", 1_800_000_000)
    os.remove(root / "Notes/n3.md")
    put(root, "Moved/n4.md", (root / "Notes/n4.md").read_bytes(), 1_800_000_000)
    os.remove(root / "Notes/n4.md")
    third = CS.sync_folder(spark, str(root), folder, SCOPE)
    assert {k: third[k] for k in ("changed", "deleted", "errors", "opened", "unchanged", "files", "possible_legacy_moves")} == dict(
        changed=2, deleted=2, errors=1, opened=3, unchanged=6, files=9, possible_legacy_moves=1
    )
    now = rows()
    assert now["Notes/n2.md"].title == "N2" and now["Notes/n1.md"].title == "n1" and now["Notes/n0.md"].metadata == {"project": "a, b"} and "Moved/n4.md" in now
    assert [r.path for r in CS.failed_reads(spark, folder, CS.store_of(spark, folder, SCOPE).manifest()[0]).collect()] == ["Notes/n2.md"]
    assert {f: t for f, t in ((f, os.stat(f).st_mtime_ns) for f in kept)} == kept
    checked = CS.sync_folder(spark, str(root), folder, SCOPE, verify=True)
    assert checked["opened"] == 8 and checked["changed"] == 1 and rows()["Notes/n0.md"].metadata == {"project": "c, d"}
    assert checked["content_digest"] != third["content_digest"]
    other = CS.Scope(buckets=4)
    assert CS.sync_folder(spark, str(root), folder, other)["reset"] and CS.store_of(spark, folder, other).read().where(F.col("path") == "pic.png").isEmpty()
