"""Task envelopes: workflow, blocks and required checks for every note at once, and budgets."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import Collection, with_collections

# Note types that are project hubs, and the checks of each workflow.
PROJECT_TYPES = ("project", "project-readme")
PROCESS_INPUT = ("read_target", "read_entrypoints", "ledger_exact", "dedupe_exact", "extract_candidates", "resolve_candidates", "update_ledger", "validate")
UPDATE_PROJECT = ("read_project_hub", "validate_hub_references", "read_declared_evidence", "sync_indexes", "validate")
UPDATE_NOTE = ("resolve_target", "read_target", "read_entrypoints", "inspect_direct_links", "extract_candidates", "resolve_candidates", "sync_indexes", "validate")
ON_CREATE = ("dedupe_exact", "ensure_stable_id")
ON_MOVE = ("compare_target_hash", "inspect_backlinks_embeds_hubs_ledger")
REGISTER = "register_ledger_input"


def _texts(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _declared(field: str, collections: list[Collection]) -> Column:
    """The values that a note's collections declare, in the note's order of collections."""
    pairs = [(c.name, getattr(c, field)) for c in collections if getattr(c, field)]
    if not pairs:
        return _texts(())
    known = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.filter(F.transform("collections", lambda c: F.try_element_at(known, c)), lambda v: v.isNotNull())


def required_checks(workflow: Column, action: str, more: Column, ledger_matched: Column) -> Column:
    """The checks of a workflow and action, then the processor's; each once."""
    at = PROCESS_INPUT.index("ledger_exact") + 1
    unregistered = PROCESS_INPUT[:at] + (REGISTER,) + PROCESS_INPUT[at:]
    process = F.when(ledger_matched, _texts(PROCESS_INPUT)).otherwise(_texts(unregistered))
    own = F.when(workflow == "process-input", process).when(workflow == "update-project", _texts(UPDATE_PROJECT)).otherwise(_texts(UPDATE_NOTE))
    acted = ON_CREATE if action == "create" else ON_MOVE if action in ("move", "delete") else ()
    return F.array_distinct(F.concat(own, _texts(acted), more))


def envelopes(
    notes: DataFrame, collections: list[Collection], processors: dict[str, tuple[str, ...]], workflow: str = "auto", action: str = "update", ledger_matched: Column | None = None
) -> DataFrame:
    """(path, workflow, processor, blocks, required_checks, ready) for notes (path, type).

    Collections decide: one declared workflow wins, several block, none means a note.  Project
    hubs are always projects.  An explicit workflow must suit the target.
    """
    placed = with_collections(notes, collections)
    declared, handled = F.array_distinct(_declared("workflow", collections)), _declared("processor", collections)
    hub = F.coalesce(F.col("type"), F.lit("")).isin(*PROJECT_TYPES)
    derived = F.when(hub, "update-project").when(F.size(declared) == 1, F.get(declared, F.lit(0))).when(F.size(declared) > 1, "").otherwise("update-note")
    processor = F.when(hub, "project").otherwise(F.coalesce(F.get(handled, F.lit(0)), F.lit("")))
    marked = placed.select("path", declared.alias("declared"), handled.alias("handled"), hub.alias("hub"), derived.alias("derived"), processor.alias("processor"))
    when = lambda test, code: F.when(test, F.lit(code))
    blocks = [when(~F.col("hub") & (F.size("declared") > 1), "workflow_registry_conflict")]
    if workflow == "auto":
        code = "workflow_required_for_create" if action == "create" else "workflow_unresolved"
        blocks.append(when(F.lit(True) if action == "create" else F.col("derived") == "", code))
        chosen = F.when(F.col("derived") == "", "unresolved").otherwise(F.col("derived"))
    else:
        misfit = {
            "process-input": ~F.array_contains("declared", "process-input"),
            "update-project": (F.col("derived") != "update-project") & ~F.array_contains("handled", "project-note"),
            "update-note": F.col("derived") == "process-input",
        }.get(workflow, F.lit(False))
        blocks.append(when(misfit, "workflow_target_mismatch"))
        chosen = F.lit(workflow)
    known = F.create_map(*[x for k, v in processors.items() for x in (F.lit(k), _texts(v))]) if processors else None
    blocks.append(when((F.col("processor") != "") & (~F.col("processor").isin(*processors) if processors else F.lit(True)), "processor_undefined"))
    more = F.coalesce(F.try_element_at(known, F.col("processor")), _texts(())) if processors else _texts(())
    matched = F.lit(False) if ledger_matched is None else ledger_matched
    found = marked.select(
        "path", chosen.alias("workflow"), "processor", F.filter(F.array(*blocks), lambda b: b.isNotNull()).alias("blocks"),
        required_checks(chosen, action, more, matched).alias("required_checks"),
    )
    return found.withColumn("ready", F.size("blocks") == 0)


def within_budget(head: dict, sections: dict[str, list], budget: int, least: int = 1200, slack: int = 16) -> dict:
    """``head`` with as many items of each section, in order, as the budget of characters allows.

    The whole compact JSON with ``slack`` more counts; a section stops at its first item that
    doesn't fit, the next one goes on.  What is left out is counted under ``omitted``.  For
    rows that are bounded already: it runs on the driver.
    """
    if budget < least:
        raise ValueError(f"the budget must be at least {least} characters")
    out = {**head, **{name: [] for name in sections}, "omitted": {name: len(items) for name, items in sections.items()}}
    size = lambda: len(json.dumps(out, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
    for name, items in sections.items():
        for item in items:
            out[name].append(item)
            out["omitted"][name] -= 1
            if size() + slack > budget:
                out[name].pop()
                out["omitted"][name] += 1
                break
    return out
