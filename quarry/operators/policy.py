"""Policy operators: thresholds, combinations, baselines, gates, lifecycles, suppressions and fingerprints.

Metric inputs are long rows (entity_id, code, value). Rule tables are small dimensions; whether they are
broadcast is left to the optimizer, which checks their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import value as V
from quarry.operators.windows import dedupe_last


def violations(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each metric with a threshold, whether it passes, how far it is out and how badly. Undefined values count as 0."""
    value, low, high = F.coalesce("value", F.lit(0.0)), F.col("min"), F.col("max")
    passed = V.contains(value, low, high)
    return metrics.join(thresholds, "code").select(
        "entity_id", "code", value.alias("value"), "min", "max", passed.alias("passed"),
        V.overshoot(value, low, high).alias("overshoot"), F.when(~passed, V.severity(value, low, high)).alias("severity"),
    )


def satisfied(metrics: DataFrame, conditions: DataFrame) -> DataFrame:
    """(rule, entity_id, excess): entities for which all conditions (rule, code, min, max) of a rule hold: relational division."""
    needed = conditions.groupBy("rule").agg(F.count("*").alias("needed"))
    value = F.coalesce("value", F.lit(0.0))
    held = metrics.join(conditions, "code").filter(V.contains(value, F.col("min"), F.col("max")))
    counted = held.groupBy("rule", "entity_id").agg(F.count("*").alias("held"), F.max(V.satisfied_excess(value, F.col("min"), F.col("max"))).alias("excess"))
    return counted.join(needed, "rule").filter("held = needed").select("rule", "entity_id", "excess")


def satisfied_conditions(metrics: DataFrame, conditions: DataFrame) -> DataFrame:
    """``satisfied`` with violations: an array of (metric, value, min, max) of the conditions that hold."""
    value = F.coalesce("value", F.lit(0.0))
    held = metrics.join(conditions, "code").filter(V.contains(value, F.col("min"), F.col("max")))
    told = F.array_sort(F.collect_list(F.struct(F.col("code").alias("metric"), value.alias("value"), "min", "max")))
    return satisfied(metrics, conditions).join(held.groupBy("rule", "entity_id").agg(told.alias("violations")), ["rule", "entity_id"])


def evaluate(metrics: DataFrame, entities: DataFrame, conditions: DataFrame) -> DataFrame:
    """(rule, entity_id, status): MATCH, NONMATCH, or UNAVAILABLE where a needed metric is absent, undefined or no finite number.

    The needed values of an entity are gathered first, so that every rule is decided within the row; rules are few,
    and each is a row of the result for each entity anyway.
    """
    needed = conditions.select("code").distinct()
    sound = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    values = metrics.join(needed, "code", "left_semi").filter(sound).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "value"))).alias("values"))
    rules = conditions.groupBy("rule").agg(F.collect_list(F.struct("code", "min", "max")).alias("conditions"))
    joined = entities.select("entity_id").join(values, "entity_id", "left").crossJoin(rules)
    value = lambda c: F.element_at("values", c["code"])
    there = F.coalesce(F.forall("conditions", lambda c: value(c).isNotNull()), F.lit(False))
    holds = F.forall("conditions", lambda c: V.contains(value(c), c["min"], c["max"]))
    return joined.select("rule", "entity_id", F.when(~there, "UNAVAILABLE").when(holds, "MATCH").otherwise("NONMATCH").alias("status"))


def rule_problems(conditions: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, code, problem): unknown metric, no bound, or bounds the wrong way round."""
    joined = conditions.join(known.select("code", F.lit(True).alias("known")), "code", "left")
    problem = F.when(F.col("known").isNull(), "unknown metric").when(F.col("min").isNull() & F.col("max").isNull(), "no bound").when(F.col("min") > F.col("max"), "inverted bounds")
    return joined.select("rule", "code", problem.alias("problem")).filter("problem is not null")


def baseline_compare(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations (entity_id, code, value, min, max) against accepted ones: a status for each pair of either side."""
    both = current.alias("n").join(baseline.alias("o"), ["entity_id", "code"], "full")
    now, old = (V.overshoot(F.col(f"{s}.value"), F.col(f"{s}.min"), F.col(f"{s}.max")) for s in "no")
    status = (
        F.when(F.col("n.value").isNull(), "RESOLVED").when(F.col("o.value").isNull(), "NEW_VIOLATION")
        .when(now > old + 1e-9, "DEGRADED").when(F.abs(now - old) < 1e-9, "UNCHANGED").otherwise("IMPROVED")
    )
    return both.select("entity_id", "code", F.col("n.value").alias("value"), F.col("o.value").alias("base_value"), status.alias("status"))


def baseline_rows(rows: DataFrame) -> DataFrame:
    """``baseline_compare`` of rows (entity_id, code, value, base_value, min, max) that hold both sides."""
    low, high = F.col("min"), F.col("max")
    broken = lambda v: F.when(~V.contains(v, low, high), v)  # noqa: E731 - null where there is no value or it passes
    both = rows.select("entity_id", "code", "min", "max", broken(F.col("value")).alias("value"), broken(F.col("base_value")).alias("base_value")).filter("value is not null or base_value is not null")
    now, old = V.overshoot(F.col("value"), low, high), V.overshoot(F.col("base_value"), low, high)
    status = (
        F.when(F.col("value").isNull(), "RESOLVED").when(F.col("base_value").isNull(), "NEW_VIOLATION")
        .when(now > old + 1e-9, "DEGRADED").when(F.abs(now - old) < 1e-9, "UNCHANGED").otherwise("IMPROVED")
    )
    return both.select("entity_id", "code", "value", "base_value", status.alias("status"))


def gate(base: DataFrame, current: DataFrame, thresholds: DataFrame, growth: DataFrame, fail_on: list[str]) -> DataFrame:
    """Findings of a two-revision gate over metric rows (entity_id, code, value).

    New entities are held against thresholds. Entities of both revisions can cross out of a threshold, grow
    beyond a budget, or (if neither grew nor crossed) have worsened. ``blocking``: the type is in ``fail_on``.
    """
    base, current = (dedupe_last(df, ["entity_id", "code"], [F.col("seq")]).drop("seq") if "seq" in df.columns else df for df in (base, current))
    now = current.join(base.select("entity_id").distinct().withColumn("old_entity", F.lit(True)), "entity_id", "left").na.fill(False, ["old_entity"])
    return gate_rows(now.join(base.withColumnRenamed("value", "base_value"), ["entity_id", "code"], "left"), thresholds, growth, fail_on)


def gate_rows(rows: DataFrame, thresholds: DataFrame, growth: DataFrame, fail_on: list[str]) -> DataFrame:
    """``gate`` of rows (entity_id, code, value, base_value, old_entity) that hold both revisions; without a value there is no finding."""
    now = rows.filter("value is not null").join(thresholds, "code", "left").join(growth, "code", "left")
    value, was, low, high, budget = (F.col(c) for c in ("value", "base_value", "min", "max", "budget"))
    has_threshold = low.isNotNull() | high.isNotNull()
    out = has_threshold & ~V.contains(value, low, high)
    new = ~F.col("old_entity") & out
    both = was.isNotNull()
    crossing = both & out & V.contains(was, low, high)
    grown = both & budget.isNotNull() & (value - was > budget)
    worse = (
        F.when(value == was, False).when(budget.isNotNull(), value > was).when(~has_threshold, False)
        .when(high.isNotNull() & low.isNull(), value > was).when(low.isNotNull() & high.isNull(), value < was)
        .otherwise(V.overshoot(value, low, high) > V.overshoot(was, low, high))
    )
    kinds = F.array_compact(F.array(
        F.when(new, "NEW_VIOLATION"), F.when(crossing, "THRESHOLD_CROSSING"), F.when(grown, "GROWTH_BUDGET"),
        F.when(both & ~F.coalesce(grown, F.lit(False)) & ~crossing & worse, "WORSENED"),
    ))
    rows = now.withColumn("type", F.explode(kinds))
    grew = F.col("type") == "GROWTH_BUDGET"
    level = F.when(grew, F.when(budget > 0, V.severity_of((value - was) / budget)).otherwise("high")).when(F.col("type") != "WORSENED", V.severity(value, low, high))
    magnitude = F.when(grew, value - was).when(F.col("type") != "WORSENED", V.overshoot(value, low, high))
    return rows.select("entity_id", "code", "type", was.alias("base_value"), "value", level.alias("severity"), magnitude.alias("magnitude"), F.col("type").isin(fail_on).alias("blocking"))


def ranked(findings: DataFrame) -> DataFrame:
    """Blocking findings first by severity, then by magnitude, metric and entity."""
    return findings.orderBy(F.col("blocking").desc(), V.severity_rank(F.col("severity")).desc_nulls_last(), F.col("magnitude").desc_nulls_last(), "code", "entity_id", "type")


def worsened(before: dict[str, Column], after: dict[str, Column], budgets: dict[str, float], kind: str, max_only: frozenset[str] = frozenset(), conditions: tuple[str, ...] = ()) -> Column:
    """Whether values rose by their budgets: RISES_BY (any), RISES_BY_WHILE_OTHERS_HOLD, ALL_RISE_BY.

    Metrics that have an upper bound only rise downwards, except for ALL_RISE_BY. A missing value is no rise;
    it also stops the search for one, in the order of the budgets.
    """
    toward = lambda c: (before[c] - after[c]) if c in max_only else (after[c] - before[c])
    missing = lambda c: before[c].isNull() | after[c].isNull()
    if kind == "ALL_RISE_BY":
        result = F.lit(True)
        for c, b in budgets.items():
            result = result & F.coalesce(after[c] - before[c] >= b, F.lit(False))
        return result
    any_rise = F.lit(False)
    for c, b in reversed(list(budgets.items())):
        any_rise = F.when(missing(c), False).when(toward(c) >= b, True).otherwise(any_rise)
    if kind == "RISES_BY":
        return any_rise
    primary = min(budgets)
    hold = F.lit(True)
    for c in conditions:
        if c != primary:
            hold = hold & F.coalesce(toward(c) >= 0, F.lit(False))
    return any_rise & hold


def lifecycle(base_status: Column, status: Column, significantly_worse: Column, comparing: bool = True) -> Column:
    """Life of a finding from the two statuses (base null: the entity is new); null where there is no finding."""
    return (
        F.when(base_status.isNull(), F.when(status == "MATCH", "NEW_ENTITY" if comparing else "CURRENT"))
        .when((status == "UNAVAILABLE") | (base_status == "UNAVAILABLE"), "COMPARISON_UNAVAILABLE")
        .when((base_status != "MATCH") & (status == "MATCH"), "INTRODUCED")
        .when((base_status == "MATCH") & (status != "MATCH"), "RESOLVED")
        .when((base_status == "MATCH") & significantly_worse, "WORSENED")
        .when(base_status == "MATCH", "EXISTING")
    )


def correspondence(base: DataFrame, current: DataFrame, moves: DataFrame) -> DataFrame:
    """(path, name, base_path): which entity of the base each current one is; then removed and added ones.

    The same (path, name) corresponds; else an entity whose path moved here with the same name. ``moves``
    (old_path, new_path); the last entry of an old path wins by ``seq``.
    """
    moved = dedupe_last(moves, ["old_path"], [F.col("seq")]).select("old_path", "new_path")
    # one aggregate tells which side an entity is on; what is on both corresponds
    sides = base.select("path", "name", F.lit(1).alias("old"), F.lit(0).alias("now")).unionByName(current.select("path", "name", F.lit(0).alias("old"), F.lit(1).alias("now")))
    sides = sides.groupBy("path", "name").agg(F.max("old").alias("old"), F.max("now").alias("now"))
    same = sides.filter("old = 1 and now = 1").select("path", "name", F.col("path").alias("base_path"), F.lit("SAME").alias("kind"))
    rest_now, rest_old = sides.filter("old = 0").select("path", "name"), sides.filter("now = 0").select("path", "name")
    by_move = rest_old.join(moved, F.col("path") == F.col("old_path")).select(F.col("new_path").alias("path"), "name", F.col("path").alias("base_path"))
    by_move = dedupe_last(rest_now.join(by_move, ["path", "name"]), ["path", "name"], [F.col("base_path")]).select("path", "name", "base_path", F.lit("MOVED").alias("kind"))
    added = rest_now.join(by_move, ["path", "name"], "left_anti").select("path", "name", F.lit(None).cast("string").alias("base_path"), F.lit("ADDED").alias("kind"))
    removed = rest_old.join(by_move.select(F.col("base_path").alias("path"), "name"), ["path", "name"], "left_anti").select(F.lit(None).cast("string").alias("path"), "name", F.col("path").alias("base_path"), F.lit("REMOVED").alias("kind"))
    return same.unionByName(by_move).unionByName(added).unionByName(removed)


def fingerprint(rule: Column, version: Column, path: Column, name: Column, signature: Column) -> Column:
    """Stable identity of a finding: SHA-256 of a JSON array; a null signature is the empty string."""
    parts = [F.lit('"v1"'), V.json_string(rule), version.cast("string"), F.lit('"v1"'), V.json_string(path), V.json_string(name), V.json_string(F.coalesce(signature, F.lit("")))]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed or same, of manifests (path, sha256)."""
    both = before.withColumnRenamed("sha256", "old").join(after.withColumnRenamed("sha256", "new"), "path", "full")
    change = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") == F.col("new"), "=").otherwise("M")
    return both.select("path", change.alias("change"))


def manifest_digest(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, digest and files of manifests (keys, path, sha256): SHA-256 over the digests of 4,096 ranges of path hashes.

    A range's entries are ordered and joined in one task, and then the ranges' digests: no task holds all entries.
    """
    entry = F.concat_ws(":", "path", "sha256")
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    ranges = manifest.groupBy(*keys, F.substring(F.md5("path"), 1, 3).alias("__range")).agg(joined(entry).alias("__digest"), F.count("*").alias("__n"))
    return ranges.groupBy(*keys).agg(joined(F.concat_ws(":", "__range", "__digest")).alias("digest"), F.sum("__n").alias("files"))


def suppressed(findings: DataFrame, suppressions: DataFrame, day: Column) -> DataFrame:
    """``findings`` (entity_id, code, type) with ix of the first suppression (ix, rule, entity_id, expires) of their rule and entity that is active on ``day``."""
    active = suppressions.filter(F.coalesce(day <= F.col("expires"), F.lit(True))).select("ix", F.col("rule").alias("type"), "entity_id")
    return findings.join(active, ["type", "entity_id"]).groupBy("entity_id", "code", "type").agg(F.min("ix").alias("ix"))


def suppression_status(applied: DataFrame, suppressions: DataFrame, day: Column) -> DataFrame:
    """(ix, rule, entity_id, status) of every suppression: APPLIED, STALE (over before ``day``) or UNUSED."""
    used = applied.select("ix", F.col("type").alias("rule"), "entity_id", F.lit(True).alias("used")).distinct()
    status = F.when(F.col("used"), "APPLIED").when(F.col("expires") < day, "STALE").otherwise("UNUSED")
    return suppressions.join(used, ["ix", "rule", "entity_id"], "left").select("ix", "rule", "entity_id", status.alias("status"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row of counters over gate findings, and whether they reconcile."""
    kind, level = F.col("type"), F.col("severity")
    counts = findings.agg(
        F.count("*").alias("total"), F.count_if("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("advisory"), F.count_distinct("entity_id").alias("entities"),
        *(F.count_if(level == s).alias(s) for s in ("high", "medium", "low")), F.count_if(level.isNull()).alias("unrated"),
        *(F.count_if(kind == k).alias(n) for k, n in (("NEW_VIOLATION", "fresh"), ("THRESHOLD_CROSSING", "crossing"), ("GROWTH_BUDGET", "grown"), ("WORSENED", "worsened"))),
    )
    total = F.col("total")
    sums = (F.expr("blocking + advisory") == total) & (F.expr("high + medium + low + unrated") == total) & (F.expr("fresh + crossing + grown + worsened") == total)
    return counts.withColumn("reconciled", sums)


def status_fold(failed: Column, incomplete: Column) -> Column:
    return F.when(failed > 0, "FAILED").when(incomplete > 0, "INCOMPLETE").otherwise("PASSED")
