"""Evaluation: set-based recall, agreement between submissions, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(passed: Column, total: Column) -> Column:
    """passed / total to four places; nothing to pass: null."""
    return F.round(F.try_divide(passed, total), 4)


def recall(wanted: DataFrame, found: DataFrame, case: str, item: str) -> DataFrame:
    """(case, wanted, hits, recall): wanted items that were found, by an equi join."""
    marked = wanted.select(case, item).distinct().join(found.select(case, item, F.lit(True).alias("hit")).distinct(), [case, item], "left")
    hits = F.count("hit")
    return marked.groupBy(case).agg(F.count(F.lit(1)).alias("wanted"), hits.alias("hits"), rate(hits, F.count(F.lit(1))).alias("recall"))


def jaccard(adopted: DataFrame, case: str, item: str, agent: str, agents: int, cases: DataFrame) -> DataFrame:
    """(case, common, either, jaccard): items all agents adopted over those any did; none at all: 1."""
    by_item = adopted.select(case, item, agent).distinct().groupBy(case, item).agg(F.count(F.lit(1)).alias("n"))
    sums = by_item.groupBy(case).agg(F.count_if(F.col("n") == agents).alias("common"), F.count(F.lit(1)).alias("either"))
    joined = cases.select(case).distinct().join(sums, case, "left")
    value = F.when(F.col("either").isNull(), 1.0).otherwise(F.round(F.col("common") / F.col("either"), 4))
    return joined.select(case, F.coalesce("common", F.lit(0)).alias("common"), F.coalesce("either", F.lit(0)).alias("either"), value.alias("jaccard"))


def rollup(cases: DataFrame, metric: str = "metric", status: str = "status") -> DataFrame:
    """(metric, total, passed, failed, skipped, rate); skipped cases don't count in the rate."""
    n = lambda s: F.count_if(F.col(status) == s)
    return cases.groupBy(metric).agg(
        F.count(F.lit(1)).alias("total"), n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"),
        rate(n("passed"), n("passed") + n("failed")).alias("rate"),
    )


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame, query: str, item: str) -> DataFrame:
    """(query, reciprocal_rank): one over the rank of the first relevant result, 0 without any."""
    hits = ranked.join(relevant.select(query, item).distinct().withColumn("good", F.lit(True)), [query, item], "left")
    return hits.groupBy(query).agg(F.round(F.coalesce(F.max(F.when(F.col("good"), 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"))


def _met(submissions: DataFrame, cases: DataFrame) -> DataFrame:
    """Each result beside its case, absent lists empty; results of no case are left out."""
    both = submissions.join(cases, "case_id")
    lists = ("must_find", "must_not_adopt", "required_evidence", "found", "opened", "returned", "adopted", "evidence")
    return both.withColumns({c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in lists})


def submission_failures(submissions: DataFrame, cases: DataFrame) -> DataFrame:
    """(agent, case_id, code, item): every rule that a result breaks.

    ``cases(case_id, expected_status, must_find, must_not_adopt, required_evidence)``;
    ``submissions(agent, case_id, status, found, opened, returned, adopted, evidence)``, where
    evidence names the fields that the result fills.  All rules are set operations
    within a row, behind one equi join.
    """
    rules = {
        "must_find_missed": F.array_except("must_find", "found"),
        "must_find_not_opened": F.array_except("must_find", "opened"),
        "must_find_without_query_evidence": F.array_except("must_find", "returned"),
        "forbidden_relation_adopted": F.array_intersect("must_not_adopt", "adopted"),
        "evidence_missing": F.array_except("required_evidence", "evidence"),
    }
    guessed = (F.col("expected_status") == "target_required") & ~F.col("status").eqNullSafe(F.lit("target_required"))
    def tagged(code: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(code).alias("code"), x.alias("item")))

    one_or_none = F.when(guessed, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    broken = [tagged(code, items) for code, items in (rules | {"ambiguous_target_guessed": one_or_none}).items()]
    return _met(submissions, cases).select("agent", "case_id", F.explode(F.concat(*broken)).alias("f")).select("agent", "case_id", "f.code", "f.item")


def submission_metrics(submissions: DataFrame, cases: DataFrame) -> DataFrame:
    """One row an agent: rates of what must be found, opened, proved and left unguessed; null where nothing was asked."""
    total = lambda c: F.sum(F.size(c))
    must, proof = total("must_find"), total("required_evidence")
    unsure = F.col("expected_status") == "target_required"
    return _met(submissions, cases).groupBy("agent").agg(
        rate(total(F.array_intersect("must_find", "found")), must).alias("must_find_recall"),
        rate(total(F.array_intersect("must_find", "opened")), must).alias("must_find_open_rate"),
        total(F.array_intersect("must_not_adopt", "adopted")).alias("forbidden_adopted"),
        rate(total(F.array_intersect("required_evidence", "evidence")), proof).alias("evidence_rate"),
        rate(F.count_if(unsure & (F.col("status") == "target_required")), F.count_if(unsure)).alias("target_safety_rate"),
    )


def consistency(submissions: DataFrame, cases: DataFrame, agents: int) -> DataFrame:
    """(case_id, status_agreement, adopted_jaccard) over ``agents`` agents; one that has no result counts as
    one with no status that adopted nothing.

    ``submissions`` has one row for each agent and case.  Items are counted by a partial
    aggregate, so a case that adopts very much is no row of its own.
    """
    given = submissions.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("results"), F.count("status").alias("stated"), F.min("status").alias("low"), F.max("status").alias("high")
    )
    items = submissions.select("agent", "case_id", F.explode(F.array_distinct("adopted")).alias("item")).groupBy("case_id", "item").agg(F.count(F.lit(1)).alias("n"))
    sums = items.groupBy("case_id").agg(F.count_if(F.col("n") == agents).alias("common"), F.count(F.lit(1)).alias("either"))
    joined = cases.select("case_id").join(given, "case_id", "left").join(sums, "case_id", "left")
    none, all_stated = F.coalesce("stated", F.lit(0)) == 0, (F.col("stated") == agents) & (F.col("low") == F.col("high"))
    share = F.when(F.col("either").isNull(), 1.0).otherwise(F.round(F.col("common") / F.col("either"), 4))
    return joined.select("case_id", F.coalesce(none | all_stated, F.lit(False)).alias("status_agreement"), share.alias("adopted_jaccard"))


def shred_results(results: DataFrame) -> DataFrame:
    """Results as rows from ``results (agent, case_id, result)``, result a JSON text; what is no object gives none.

    (agent, case_id, status, found, opened, returned, adopted, evidence, bad_queries, bad_decisions): evidence names the fields that
    hold a filled list.  A query needs a text, a mode, an exit code and a list of paths, else it is bad and returns nothing; one bad
    decision spoils all of a result's.  Members are judged by their stored types.
    """
    root = F.try_parse_json("result")
    kind = lambda v, *names: F.coalesce(F.schema_of_variant(v).rlike("^(" + "|".join(names) + ")"), F.lit(False))
    member = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    text = lambda v, name: F.when(kind(member(v, name), "STRING"), F.try_variant_get(v, f"$.{name}", "string"))
    none, many = F.array().cast("array<string>"), F.array().cast("array<variant>")
    listed = lambda v: F.coalesce(F.when(kind(v, "ARRAY"), v.try_cast("array<variant>")), many)
    texts = lambda v: F.transform(listed(v), lambda x: x.try_cast("string"))
    filled = lambda v, name: F.coalesce(text(v, name) != "", F.lit(False))
    r = F.col("r")
    good_query = lambda q: kind(q, "OBJECT") & filled(q, "query") & F.coalesce(text(q, "mode").isin("exact", "broad"), F.lit(False)) & kind(member(q, "exit_code"), "BIGINT", "BOOLEAN") & kind(member(q, "returned_paths"), "ARRAY")  # noqa: E731, E501
    good_decision = lambda d: kind(d, "OBJECT") & text(d, "path").isNotNull() & F.coalesce(text(d, "decision").isin("adopt", "reject", "defer"), F.lit(False)) & filled(d, "reason")  # noqa: E731, E501
    queries, decisions = member(r, "queries"), member(r, "decisions")
    odd = lambda v: v.isNotNull() & ~kind(v, "ARRAY")
    spoilt = odd(decisions) | F.exists(listed(decisions), lambda d: ~good_decision(d))
    chosen = F.transform(F.filter(listed(decisions), lambda d: text(d, "decision") == "adopt"), lambda d: text(d, "path"))
    fields = F.map_filter(r.try_cast("map<string, variant>"), lambda _, v: kind(v, "ARRAY") & (F.size(listed(v)) > 0))
    rows = results.select("agent", "case_id", root.alias("r")).where(kind(r, "OBJECT"))
    return rows.select(
        "agent", "case_id", text(r, "status").alias("status"), texts(member(r, "found_paths")).alias("found"), texts(member(r, "opened_paths")).alias("opened"),
        F.flatten(F.transform(F.filter(listed(queries), good_query), lambda q: texts(member(q, "returned_paths")))).alias("returned"),
        F.when(spoilt, none).otherwise(chosen).alias("adopted"), F.map_keys(fields).alias("evidence"),
        (F.size(F.filter(listed(queries), lambda q: ~good_query(q))) + odd(queries).cast("int")).alias("bad_queries"), spoilt.alias("bad_decisions"),
    )


def evaluation_failures(results: DataFrame, cases: DataFrame, files: DataFrame, agents: list[str]) -> DataFrame:
    """(agent, case_id, code, item): every rule that the results of ``agents`` break.

    Beside those of ``submission_failures``: a case without a result, another status than expected (``completed`` where none
    is named), bad queries and decisions, and evidence of paths that ``files (path)`` doesn't hold.  Results are those of
    ``shred_results``; each case is met once for each of the stated agents.
    """
    asked = cases.select("case_id", F.coalesce("expected_status", F.lit("completed")).alias("expected"), F.explode(F.array(*map(F.lit, agents))).alias("agent"))
    rows = lambda df, code, item=None: df.select("agent", "case_id", F.lit(code).alias("code"), (F.lit("") if item is None else item).alias("item"))
    met = asked.join(results, ["agent", "case_id"])
    named = F.array_distinct(F.concat("found", "opened", "returned"))
    paths = met.select("agent", "case_id", F.explode(named).alias("path")).join(files.select("path"), "path", "left_anti")
    return (
        submission_failures(results, cases)
        .unionByName(rows(asked.join(results.select("agent", "case_id"), ["agent", "case_id"], "left_anti"), "submission_case_missing"))
        .unionByName(rows(met.where(~F.col("status").eqNullSafe(F.col("expected"))), "submission_status_mismatch"))
        .unionByName(rows(met.select("agent", "case_id", F.explode(F.array_repeat(F.lit(1), F.col("bad_queries")))), "query_evidence_invalid"))
        .unionByName(rows(met.where("bad_decisions"), "decision_evidence_invalid"))
        .unionByName(rows(paths, "evidence_path_missing", F.col("path")))
    )
