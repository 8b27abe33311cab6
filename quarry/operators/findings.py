"""Findings of versioned rules over two revisions: identity, lifecycle, disposition, order and presentation.

Entities are (path, name, signature); a null signature is a class. Measures are rows (path, name, signature, code, value).
Rules are dicts as ``catalogue_rules.Policy.rules`` gives them, some tens at most; each is a set of columns over rows
that hold an entity's values of both revisions, so all rules are decided in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import value as V
from quarry.operators import policy as P
from quarry.operators.windows import first_match

ENTITY = ["path", "name", "signature"]


def wide(measures: DataFrame, codes: list[str]) -> DataFrame:
    """One row an entity with ``values``, a map of the finite values of ``codes``."""
    sound = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & F.col("code").isin(*codes)
    return measures.groupBy(*ENTITY).agg(F.map_from_entries(F.collect_list(F.when(sound, F.struct("code", "value")))).alias("values"))


def correspond(base: DataFrame, current: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """Entities of both revisions side by side: (path, name, signature, after, base_path, before); after or before is null where one side has none.

    The same entity corresponds; else one whose path moved here (``moves``: old_path, new_path), with the same name and signature.
    """
    key = lambda d: [F.coalesce(F.col(f"{d}.signature"), F.lit("")), F.col(f"{d}.path"), F.col(f"{d}.name")]

    def same(a: str, b: str) -> Column:
        left, right = key(a), key(b)
        return (left[0] == right[0]) & (left[1] == right[1]) & (left[2] == right[2])

    now, old = current.withColumnRenamed("values", "after"), base.withColumnRenamed("values", "before")
    if moves is not None:
        here = now.select(*ENTITY).alias("n")
        moved = old.alias("o").join(moves.select("old_path", "new_path").alias("m"), F.col("o.path") == F.col("m.old_path")).join(here, same("o", "n"), "left_anti")
        moved = moved.select(F.col("m.new_path").alias("path"), "o.name", "o.signature", F.col("o.before").alias("before"), F.col("o.path").alias("base_path"))
        stay = old.alias("o").join(moved.select(F.col("base_path").alias("path"), "name", "signature").alias("n"), same("o", "n"), "left_anti").select("o.*", F.col("o.path").alias("base_path"))
        old = stay.select(*ENTITY, "before", "base_path").unionByName(moved.select(*ENTITY, "before", "base_path"))
    else:
        old = old.withColumn("base_path", F.col("path"))
    joined = now.alias("n").join(old.alias("o"), same("n", "o"), "full")
    return joined.select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ENTITY), "after", "base_path", "before")


def status(values: Column, rule: dict) -> Column:
    """MATCH, NONMATCH or UNAVAILABLE of a rule for a map of values."""
    at = {c: F.element_at(values, F.lit(c)) for c, _, _ in rule["conditions"]}
    there, holds = F.lit(True), F.lit(True)
    for c, low, high in rule["conditions"]:
        there = there & at[c].isNotNull()
        holds = holds & V.contains(at[c], F.lit(low).cast("double"), F.lit(high).cast("double"))
    return F.when(~F.coalesce(there, F.lit(False)), "UNAVAILABLE").when(holds, "MATCH").otherwise("NONMATCH")


def evaluate(pairs: DataFrame, rules: list[dict], roles: list[tuple[str, str]], read: DataFrame | None = None, changed: DataFrame | None = None, advisory: bool = False) -> DataFrame:
    """Findings of ``pairs`` (see ``correspond``), one row for each rule and entity that has one.

    ``read``: paths (path) that the current revision still reads, without which a removed entity isn't known to be
    resolved. ``changed``: paths (path) of the changed set; matches outside it are existing debt and never block.
    """
    spark = pairs.sparkSession
    rows = pairs.withColumn("role", first_match(F.col("path"), roles, "UNKNOWN"))
    rows = rows.join(read.select("path").distinct().withColumn("still", F.lit(True)), "path", "left").na.fill(False, ["still"]) if read is not None else rows.withColumn("still", F.lit(True))
    rows = rows.join(changed.select("path").distinct().withColumn("eligible", F.lit(True)), "path", "left").na.fill(False, ["eligible"]) if changed is not None else rows.withColumn("eligible", F.lit(True))
    kinds = []
    for rule in rules:
        level = F.col("signature").isNotNull() if rule["level"] == "method" else F.col("signature").isNull()
        fits = level & (F.col("role").isin(*rule["roles"]) if rule["roles"] else F.lit(True))
        after, before = F.col("after"), F.col("before")
        now, was = F.when(after.isNotNull(), status(after, rule)), F.when(before.isNotNull(), status(before, rule))
        codes = [c for c, _, _ in rule["conditions"]]
        values = lambda m: {c: F.element_at(m, F.lit(c)) for c in {*codes, *rule["budgets"]}}  # noqa: B023, E731
        falling = frozenset(c for c, low, high in rule["conditions"] if low is None and high is not None)
        worse = P.worsened(values(before), values(after), rule["budgets"], rule["worsening"], falling, tuple(codes))
        life = F.when(after.isNull(), F.when((was == "MATCH") & F.col("still"), "RESOLVED")).otherwise(P.lifecycle(was, now, worse))
        outside = F.when(now == "MATCH", "EXISTING")
        evidence = F.array(*(F.struct(F.lit(c).alias("code"), F.element_at(before, F.lit(c)).alias("before"), F.element_at(after, F.lit(c)).alias("after"), F.lit(low).cast("double").alias("min"), F.lit(high).cast("double").alias("max")) for c, low, high in rule["conditions"]))
        kinds.append(F.when(fits, F.struct(
            F.lit(rule["rule"]).alias("rule"), F.lit(rule["version"]).alias("version"), F.lit(rule["title"]).alias("title"), F.lit(rule["severity"]).alias("severity"), F.lit(rule["maturity"]).alias("maturity"),
            F.coalesce(now, F.lit("NONMATCH")).alias("status"), F.when(F.col("eligible"), life).otherwise(outside).alias("lifecycle"), F.lit(rule["mode"] == "error" and not advisory).alias("flag"), evidence.alias("evidence"),
        )))
    if not kinds:
        return spark.createDataFrame([], rows.schema).limit(0)
    found = rows.select(*ENTITY, "base_path", "role", "eligible", F.explode(F.array_compact(F.array(*kinds))).alias("f")).select(*ENTITY, "base_path", "role", "eligible", "f.*").filter("lifecycle is not null")
    print_ = lambda path: P.fingerprint(F.col("rule"), F.col("version"), F.col(path), F.col("name"), F.col("signature"))
    found = found.withColumn("fingerprint", print_("path")).withColumn("previous_fingerprint", F.when(F.col("base_path") != F.col("path"), print_("base_path")))
    disposition = F.when(~F.col("eligible"), "EXISTING").when(F.col("lifecycle") == "RESOLVED", "NOT_MATCHED").otherwise("ACTIVE")
    found = found.withColumn("disposition", disposition).withColumn("reason", F.when(~F.col("eligible"), "outside the changed set"))
    return found.withColumn("blocking", _blocks())


def _blocks() -> Column:
    return F.col("flag") & (F.col("disposition") == "ACTIVE") & F.coalesce(F.col("lifecycle").isin("NEW_ENTITY", "INTRODUCED", "WORSENED"), F.lit(False)) & (F.col("status") == "MATCH")


def suppress(findings: DataFrame, suppressions: DataFrame, day: Column) -> DataFrame:
    """Active findings of a suppressed rule and entity are SUPPRESSED; ``suppressions`` (ix, rule, path, name, signature, reason, expires), the first active one counts."""
    active = suppressions.filter(F.coalesce(day <= F.col("expires"), F.lit(True)))
    sign = F.coalesce("signature", F.lit("")).alias("__sign")
    first = active.withColumn("__n", F.row_number().over(Window.partitionBy("rule", "path", "name", "signature").orderBy("ix"))).filter("__n = 1").select("rule", "path", "name", sign, F.col("reason").alias("__why"))
    joined = findings.withColumn("__sign", F.coalesce("signature", F.lit(""))).join(first, ["rule", "path", "name", "__sign"], "left")
    hit = F.col("__why").isNotNull() & (F.col("disposition") == "ACTIVE")
    out = joined.withColumn("reason", F.when(hit, F.col("__why")).otherwise(F.col("reason"))).withColumn("disposition", F.when(hit, "SUPPRESSED").otherwise(F.col("disposition")))
    return out.withColumn("blocking", _blocks()).select(*findings.columns)


def accept(findings: DataFrame, baseline: DataFrame, rules: list[dict]) -> DataFrame:
    """Active findings in ``baseline`` (fingerprint, accepted: map of values) are ACCEPTED, unless they are significantly worse than what was accepted.

    Looked up by fingerprint, and where that isn't there by the fingerprint before a move.
    """
    entries = baseline.select(F.col("fingerprint").alias("__print"), F.col("accepted").alias("__accepted"))
    own = findings.join(entries, F.col("fingerprint") == F.col("__print"), "left")
    earlier = entries.select(F.col("__print").alias("__before"), F.col("__accepted").alias("__earlier"))
    both = own.join(earlier, F.col("previous_fingerprint") == F.col("__before"), "left")
    known = F.col("__print").isNotNull() | F.col("__before").isNotNull()
    accepted = F.when(F.col("__print").isNotNull(), F.col("__accepted")).otherwise(F.col("__earlier"))
    now = F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["code"].alias("key"), e["after"].alias("value"))))
    worse = F.lit(False)
    for rule in rules:
        codes = [c for c, _, _ in rule["conditions"]]
        falling = frozenset(c for c, low, high in rule["conditions"] if low is None and high is not None)
        values = lambda m: {c: F.element_at(m, F.lit(c)) for c in {*codes, *rule["budgets"]}}  # noqa: B023, E731
        worse = F.when(F.col("rule") == rule["rule"], P.worsened(values(accepted), values(now), rule["budgets"], rule["worsening"], falling, tuple(codes))).otherwise(worse)
    worse = F.coalesce(worse & (F.size(accepted) > 0), F.lit(False))
    debt = known & (F.col("disposition") == "ACTIVE") & ~worse
    beyond = known & (F.col("disposition") == "ACTIVE") & worse
    out = both.withColumn("reason", F.when(debt, "accepted in the baseline").when(beyond, "worse than accepted").otherwise(F.col("reason")))
    out = out.withColumn("lifecycle", F.when(beyond, "WORSENED").otherwise(F.col("lifecycle"))).withColumn("disposition", F.when(debt, "ACCEPTED").otherwise(F.col("disposition")))
    return out.withColumn("blocking", _blocks()).select(*findings.columns)


def baseline_of(findings: DataFrame) -> DataFrame:
    """(fingerprint, rule, path, name, signature, accepted) of all active matches, in the order of rule, entity and fingerprint."""
    values = F.map_from_entries(F.transform(F.filter("evidence", lambda e: e["after"].isNotNull()), lambda e: F.struct(e["code"].alias("key"), e["after"].alias("value"))))
    rows = findings.filter("status = 'MATCH' and disposition != 'SUPPRESSED'").select("fingerprint", "rule", *ENTITY, values.alias("accepted"))
    return rows.orderBy("rule", "path", "name", F.col("signature").asc_nulls_first(), "fingerprint")


def stale(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """Entries of the baseline that no finding has any more."""
    prints = findings.select("fingerprint").unionByName(findings.filter("previous_fingerprint is not null").select(F.col("previous_fingerprint").alias("fingerprint")))
    return baseline.join(prints.distinct(), "fingerprint", "left_anti")


def deduplicated(findings: DataFrame) -> DataFrame:
    """One row for each rule, version and entity: the first by order, blocking as soon as one is, with the evidence of all."""
    order = [F.col("blocking").desc(), "fingerprint", "lifecycle"]
    group = Window.partitionBy("rule", "version", *ENTITY)
    merged = F.array_distinct(F.flatten(F.collect_list("evidence").over(group)))
    rows = findings.withColumn("__n", F.row_number().over(group.orderBy(*order))).withColumn("__all", merged).withColumn("__any", F.max("blocking").over(group))
    return rows.filter("__n = 1").withColumn("evidence", F.col("__all")).withColumn("blocking", F.col("__any")).select(*findings.columns)


def ordered(findings: DataFrame) -> DataFrame:
    """Blocking ones first, then by entity, rule, version and fingerprint."""
    return findings.orderBy(F.col("blocking").desc(), "path", "name", F.col("signature").asc_nulls_first(), "rule", "version", "fingerprint")


def compact(findings: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` findings without unchanged debt, with shown_of and dropped: how many there were, and how many were debt."""
    debt = (F.col("lifecycle") == "EXISTING") | F.col("disposition").isin("EXISTING", "ACCEPTED")
    counts = findings.agg(F.count_if(~debt).alias("shown_of"), F.count_if(debt).alias("dropped"))  # one row
    return ordered(findings.filter(~debt)).limit(k).crossJoin(F.broadcast(counts))


def summary(findings: DataFrame) -> DataFrame:
    """One row of counters, and whether the dispositions add up to the total."""
    by = lambda column, names: [F.count_if(F.col(column) == n).alias(n.lower()) for n in names]
    counts = findings.agg(
        F.count("*").alias("total"), F.count_if("blocking").alias("blocking"), F.count_distinct("path", "name", F.coalesce("signature", F.lit(""))).alias("entities"),
        *by("disposition", ("ACTIVE", "SUPPRESSED", "ACCEPTED", "NOT_MATCHED")), F.count_if(F.col("disposition") == "EXISTING").alias("outside"),
        *by("lifecycle", ("NEW_ENTITY", "INTRODUCED", "WORSENED", "EXISTING", "RESOLVED", "COMPARISON_UNAVAILABLE")),
    )
    return counts.withColumn("reconciled", F.expr("active + suppressed + accepted + not_matched + outside = total"))


def reportable(findings: DataFrame) -> DataFrame:
    """Findings that an external report shows: active ones and those that no longer match."""
    return findings.filter(F.col("disposition").isin("ACTIVE", "NOT_MATCHED"))
