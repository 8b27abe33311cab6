"""Report builders. Nesting is done by Spark; only small summaries are rendered on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.value import severity_rank
from quarry.operators.findings import baseline_of
from quarry.sinks import documents

BASELINE_SCHEMA = 1
LEVELS = {"high": "error", "medium": "warning", "low": "note"}


def metric_tree(metrics: DataFrame) -> DataFrame:
    """One row a package: classes nested with their methods, values as formatted strings, everything sorted by name."""
    integral = F.col("is_integral") if "is_integral" in metrics.columns else F.lit(False)
    shown = F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", documents.shown(F.col("value"), integral)))))
    entities = metrics.groupBy("level", "entity_id", "parent_id").agg(shown.alias("metrics"))
    at = lambda level: entities.filter(F.col("level") == level).drop("level")
    methods = at("method").groupBy("parent_id").agg(_sorted("entity_id", "metrics").alias("methods")).withColumnRenamed("parent_id", "entity_id")
    classes = at("class").join(methods, "entity_id", "left").groupBy("parent_id").agg(_sorted("entity_id", "metrics", "methods").alias("classes")).withColumnRenamed("parent_id", "entity_id")
    return at("package").join(classes, "entity_id", "left").select(F.col("entity_id").alias("package"), "metrics", "classes")


def _sorted(*columns: str) -> Column:
    by_name = lambda a, b: F.when(a["entity_id"] < b["entity_id"], -1).when(a["entity_id"] > b["entity_id"], 1).otherwise(0)
    return F.array_sort(F.collect_list(F.struct(*columns)), by_name)


def write_accepted(findings: DataFrame, path: str, policy_digest: str, required_gaps: int = 0) -> None:
    """The findings to accept, as a baseline of schema 1; refused over an existing one or while required measurements are missing."""
    if required_gaps:
        raise ValueError(f"{required_gaps} required measurements are missing; no baseline is written")
    rows = baseline_of(findings).withColumn("schema", F.lit(BASELINE_SCHEMA)).withColumn("policy", F.lit(policy_digest))
    rows.write.mode("errorifexists").json(path)


def read_accepted(spark, path: str, policy_digest: str) -> DataFrame:
    """A baseline that ``write_accepted`` wrote with the same policy; others are refused."""
    found = spark.read.schema("fingerprint string, rule string, path string, name string, signature string, accepted map<string, double>, schema int, policy string").json(path)
    if not found.filter(~F.col("schema").eqNullSafe(F.lit(BASELINE_SCHEMA))).isEmpty():
        raise ValueError(f"the baseline isn't of schema {BASELINE_SCHEMA}")
    if not found.filter(~F.col("policy").eqNullSafe(F.lit(policy_digest))).isEmpty():
        raise ValueError("the baseline was written with another policy")
    return found.drop("schema", "policy")


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def validation(violations: DataFrame) -> DataFrame:
    """One row a file with its failures."""
    return violations.filter("not passed").groupBy(F.col("entity_id").alias("file")).agg(F.array_sort(F.collect_list(F.struct("code", "value", "min", "max", "severity"))).alias("failures"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF 2.1.0 result objects of findings (rule, entity_id, severity, fingerprint)."""
    level = F.coalesce(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.col("severity")], F.lit("none"))
    location = F.struct(F.struct(F.struct(F.col("entity_id").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    return findings.select(
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" ", F.col("rule"), F.lit("matches"), F.col("entity_id")).alias("text")).alias("message"),
        F.array(location).alias("locations"), F.create_map(F.lit("quarry/v1"), F.col("fingerprint")).alias("partialFingerprints"),
    )


def sarif_log(findings: DataFrame) -> DataFrame:
    """The whole log as one JSON value. It is one document by format; use sarif_results() for large sets."""
    one = sarif_results(findings).agg(F.sort_array(F.collect_list(F.struct("ruleId", "level", "message", "locations", F.map_entries("partialFingerprints").alias("prints")))).alias("results"))
    results = F.transform("results", lambda r: F.struct(r["ruleId"].alias("ruleId"), r["level"].alias("level"), r["message"].alias("message"), r["locations"].alias("locations"), F.map_from_entries(r["prints"]).alias("partialFingerprints")))
    run = F.struct(F.struct(F.struct(F.lit("quarry").alias("name")).alias("driver")).alias("tool"), results.alias("results"))
    return one.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def markdown(findings: DataFrame, k: int = 20) -> str:
    """The k most severe findings as a list, with the number left out: a summary for readers."""
    total = findings.count()
    top = findings.orderBy(severity_rank(F.col("severity")).desc_nulls_last(), "rule", "entity_id").limit(k).collect()
    lines = [f"# Findings: {total}", "", *(f"- **{r.rule}** {r.entity_id} ({r.severity})" for r in top)]
    return "\n".join([*lines, f"- … {total - k} more"] if total > k else lines) + "\n"


def write_baseline(findings: DataFrame, path: str, required_gaps: int = 0) -> None:
    """Accepted findings as JSON; refused over an existing baseline or while required measurements are missing."""
    if required_gaps:
        raise ValueError(f"{required_gaps} required measurements are missing; no baseline is written")
    findings.write.mode("errorifexists").json(path)


ADAPTERS: dict[tuple[str, str], Callable] = {
    ("analyze", "json"): lambda df: json_lines(metric_tree(df)),
    ("validate", "json"): lambda df: json_lines(validation(df)),
    ("detect", "json"): json_lines,
    ("detect", "sarif"): sarif_log,
    ("detect", "markdown"): markdown,
}


def render(report: str, form: str, df: DataFrame):
    if (report, form) not in ADAPTERS:
        raise ValueError(f"no {form} report for {report}")
    return ADAPTERS[report, form](df)


def html(findings: DataFrame, k: int = 200) -> str:
    """A page with the k most severe findings and counts by severity: a summary for readers."""
    from html import escape

    counts = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}
    top = findings.orderBy(severity_rank(F.col("severity")).desc_nulls_last(), "rule", "entity_id").limit(k).collect()
    rows = "".join(f"<tr><td>{escape(r.rule)}</td><td>{escape(r.entity_id)}</td><td>{escape(r.severity or '')}</td></tr>" for r in top)
    summary = ", ".join(f"{escape(s or 'unrated')}: {n}" for s, n in sorted(counts.items(), key=str))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Findings</title></head><body><p>{summary}</p><table><tr><th>Rule</th><th>Entity</th><th>Severity</th></tr>{rows}</table></body></html>"


ADAPTERS["detect", "html"] = html


def read_baseline(spark, path: str, policy_digest: str) -> DataFrame:
    """Accepted findings written with the same policy; those of another policy are refused."""
    found = spark.read.schema("rule string, entity_id string, severity string, fingerprint string, policy string").json(path)
    if not found.filter(~F.col("policy").eqNullSafe(F.lit(policy_digest))).isEmpty():
        raise ValueError("the baseline was written with another policy")
    return found
