"""The gate: two revisions of a repository analysed and compared, by thresholds and by the rules of a policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import findings as FN
from quarry.operators import graph, policy, scope
from quarry.plans import java_metrics
from quarry.sources import catalogue_rules, config, revisions


@dataclass
class Gate:
    plan: revisions.Plan
    subjects: DataFrame  # path
    violations: DataFrame  # file, entity_id, code, type, base_value, value, severity, magnitude
    warnings: DataFrame
    findings: DataFrame
    issues: DataFrame  # file, code, reason, required
    before_digest: str | None
    after_digest: str | None
    policy_digest: str

    def status(self) -> tuple[str, int]:
        """FAILED (1) with violations or blocking findings, else INCOMPLETE (2) with required gaps, else PASSED (0)."""
        failed = not self.violations.isEmpty() or not self.findings.filter("blocking").isEmpty()
        if failed:
            return "FAILED", 1
        return ("INCOMPLETE", 2) if not self.issues.filter("required").isEmpty() else ("PASSED", 0)


def subject_paths(plan: revisions.Plan, exclude: list[str]) -> DataFrame:
    """Changed paths that the after side has, without excluded ones."""
    rows = plan.changes.filter("new_path is not null and status != 'D'").select(F.col("new_path").alias("path")).distinct()
    for pattern in exclude:
        rows = rows.filter(~scope.qualified_name(F.col("path")).rlike(pattern))
    return rows


def _digest(manifest: DataFrame) -> str | None:
    row = policy.manifest_digest(manifest.select(F.lit(0).alias("all"), "path", F.col("blob").alias("sha256")), ["all"]).first()
    return row and row.digest


def run(spark: SparkSession, repo: str, base: str, mode: str | None = None, project: config.Project | None = None, rules: catalogue_rules.Policy | None = None, day: str | None = None, baseline: DataFrame | None = None, advisory: bool = False) -> Gate:
    """Compare ``base`` with a later state (``mode``). An empty comparison isn't analysed."""
    project = project or config.Project()
    rules = rules or (catalogue_rules.policy(project.policy) if project.policy else catalogue_rules.Policy())
    plan = revisions.plan(spark, repo, base, mode or project.gate.get("mode") or "worktree")
    subjects = graph.kept(subject_paths(plan, project.exclusions))
    gone = plan.changes.filter("status = 'D'").select(F.col("old_path").alias("path")).distinct()
    before, after = plan.before, plan.after
    if subjects.isEmpty() and gone.isEmpty():
        before, after = before.limit(0), after.limit(0)
    was = java_metrics.measure(spark, revisions.contents(repo, before))
    now = java_metrics.measure(spark, revisions.contents(repo, after, plan.from_git))

    known = {c for codes in (java_metrics.METHOD_CODES, java_metrics.CLASS_CODES, java_metrics.PACKAGE_CODES, java_metrics.PROJECT_CODES) for c in codes}
    limits = project.limits(spark, known)
    limits = limits if limits is not None else config.profile(spark, "standard")
    growth = spark.createDataFrame(list(project.growth().items()), "code string, budget double")
    places = now.entities().join(subjects, "path", "left_semi").select("level", "entity_id", "path")
    levels = "level in ('class', 'method')"
    changed = now.metrics.filter(levels).join(places.select("level", "entity_id"), ["level", "entity_id"], "left_semi").select("entity_id", "code", F.coalesce("value", F.lit(0.0)).alias("value"))
    found = policy.gate(was.metrics.filter(levels).select("entity_id", "code", F.coalesce("value", F.lit(0.0)).alias("value")), changed, limits, growth, project.fail_on())
    found = graph.kept(found.join(places.select("entity_id", F.col("path").alias("file")), "entity_id"))

    active = rules.rules()
    codes = sorted({c for r in active for c in (*r["budgets"], *(c for c, _, _ in r["conditions"]))})
    moves = plan.changes.filter("old_path is not null and new_path is not null and old_path != new_path").select("old_path", "new_path").dropDuplicates(["old_path"])
    pairs = FN.correspond(FN.wide(was.measures(), codes), FN.wide(now.measures(), codes), moves)
    read = plan.after.select("path")
    rows = FN.evaluate(pairs, active, rules.roles, read, subjects.unionByName(gone).distinct(), advisory)
    hidden = [(i, s["rule"], s["path"], s["name"], s.get("signature"), s["reason"], s.get("expires")) for i, s in enumerate(rules.suppressions)]
    listed = spark.createDataFrame(hidden, "ix int, rule string, path string, name string, signature string, reason string, expires string").withColumn("expires", F.to_date("expires"))
    rows = FN.suppress(rows, listed, F.lit(day).cast("date") if day else F.current_date())
    if baseline is not None:
        rows = FN.accept(rows, baseline, active)
    rows = graph.kept(FN.deduplicated(rows))

    parsed, odd = now.tables["files"].select("path"), now.tables["unsupported"].select("path")
    measured = now.measures().filter("value is not null").select("path", "code").distinct()
    required = spark.createDataFrame([(c, True) for c in codes], "code string, required boolean")
    with_classes = now.tables["classes"].select("path").distinct()
    issues = scope.completeness(subjects, parsed, odd, measured.unionByName(subjects.join(with_classes, "path", "left_anti").crossJoin(required.select("code"))), required)
    return Gate(plan, subjects, found.filter("blocking"), found.filter("not blocking"), rows, graph.kept(issues), _digest(plan.before), _digest(plan.after), rules.digest())
