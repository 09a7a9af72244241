"""Configuration: a TOML file read on the driver into typed, checked settings."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

from .operators.catalog import Collection

FILE, VARIABLE = "scriptorium.toml", "SCRIPTORIUM_CONFIG"
# The workflows that a collection may declare.
WORKFLOWS = ("process-input", "update-note", "update-project")


class ConfigError(ValueError):
    """A setting that can't be used, named in the message."""


@dataclass(frozen=True)
class Settings:
    vault: str
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    chunk_size: int
    chunk_overlap: int
    dense_candidates: int
    sparse_candidates: int
    top_k: int
    rrf_k: int
    identity_paths: tuple[str, ...]
    include_non_markdown: bool
    collections: tuple[Collection, ...]
    processors: dict[str, tuple[str, ...]]
    scopes: dict[str, tuple[str, ...]]


class _Reader:
    """Typed access to nested tables; every error names its key."""

    def __init__(self, data: dict, name: str = "") -> None:
        self.data, self.name = data, name

    def _get(self, key: str, kind: type, default):
        value = self.data.get(key, default)
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            raise ConfigError(f"{self.name}{key} must be {kind.__name__}")
        return value

    def table(self, key: str) -> _Reader:
        return _Reader(self._get(key, dict, {}), f"{self.name}{key}.")

    def number(self, key: str, default: int, least: int = 1) -> int:
        value = self._get(key, int, default)
        if value < least:
            raise ConfigError(f"{self.name}{key} must be at least {least}")
        return value

    def text(self, key: str, default: str = "") -> str:
        return self._get(key, str, default).strip()

    def flag(self, key: str, default: bool) -> bool:
        return self._get(key, bool, default)

    def texts(self, key: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
        values = self._get(key, list, list(default))
        if not all(isinstance(v, str) for v in values):
            raise ConfigError(f"{self.name}{key} must hold strings")
        return tuple(values)

    def paths(self, key: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
        found = tuple(re.sub(r"^\./", "", v.replace("\\", "/")).rstrip("/") or "." for v in self.texts(key, default))
        for v in found:
            if v.startswith("/") or re.match(r"[A-Za-z]:", v) or ".." in v.split("/"):
                raise ConfigError(f"{self.name}{key}: {v} leaves the vault")
        return found


def find(path: str | None = None) -> Path:
    """The file named, or that of the environment, or the nearest one above the working folder."""
    named = path or os.environ.get(VARIABLE)
    if named:
        if not Path(named).is_file():
            raise ConfigError(f"{named} isn't there")
        return Path(named)
    for folder in (Path.cwd(), *Path.cwd().parents):
        if (folder / FILE).is_file():
            return folder / FILE
    raise ConfigError(f"no {FILE} here or above")


def load(path: str | None = None) -> Settings:
    where = find(path)
    try:
        data = _Reader(tomllib.loads(where.read_text(encoding="utf-8")))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{where}: {e}") from e
    vault, index, catalog, retrieval = map(data.table, ("vault", "index", "catalog", "retrieval"))
    include = vault.paths("include", (".",))
    if not include:
        raise ConfigError("vault.include must not be empty")
    size, overlap = index.number("chunk_size", 1200), index.number("chunk_overlap", 150, 0)
    if overlap >= size:
        raise ConfigError("index.chunk_overlap must be below index.chunk_size")
    listed = catalog.table("processors")
    processors = {name: listed.table(name).texts("required_checks") for name in listed.data}
    parts, collections = catalog.table("collections"), []
    for name in parts.data:
        c = parts.table(name)
        made = Collection(name, c.paths("paths"), c.text("role"), c.text("workflow"), c.text("processor"), c.paths("entrypoints"), c.texts("related"))
        if not made.paths:
            raise ConfigError(f"{c.name}paths must not be empty")
        if made.workflow and made.workflow not in WORKFLOWS:
            raise ConfigError(f"{c.name}workflow must be one of {', '.join(WORKFLOWS)}")
        if made.processor and made.processor not in processors:
            raise ConfigError(f"{c.name}processor {made.processor} isn't declared")
        collections.append(made)
    for c in collections:
        if unknown := set(c.related) - set(parts.data):
            raise ConfigError(f"catalog.collections.{c.name}.related: {sorted(unknown)[0]} isn't a collection")
    scopes = data.table("scopes")
    return Settings(
        str((where.parent / vault.text("path", ".")).resolve()), include, vault.paths("exclude"), size, overlap,
        retrieval.number("dense_candidates", 40), retrieval.number("sparse_candidates", 40), retrieval.number("top_k", 6), retrieval.number("rrf_k", 60),
        catalog.paths("identity_paths"), catalog.flag("include_non_markdown", False), tuple(collections), processors,
        {name: scopes.table(name).paths("paths") for name in scopes.data},
    )


def render(vault: str) -> str:
    """A configuration to begin with."""
    return f"""[vault]
path = {vault!r}
include = ["."]
exclude = [".git"]

[index]
chunk_size = 1200
chunk_overlap = 150

[retrieval]
dense_candidates = 40
sparse_candidates = 40
top_k = 6
rrf_k = 60
"""


def write(path: str, vault: str, force: bool = False) -> None:
    if Path(path).exists() and not force:
        raise ConfigError(f"{path} is there already")
    Path(path).write_text(render(vault), encoding="utf-8")
