"""Whole reports as single JSON documents. Spark nests and sorts; a document is one value by its format, so use the row forms for large sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.value import display, severity_rank
from quarry.plans.java_metrics import Analysis
from quarry.sources import metric_catalogue


def shown(value: Column, integral: Column) -> Column:
    """A metric value as reports print it: counts without decimals, N/A where undefined."""
    return F.when(integral & value.isNotNull(), value.cast("long").cast("string")).otherwise(display(value))


def by_level(metrics: DataFrame) -> DataFrame:
    """(level, entity_id, parent_id, metrics): an array of (code, value as text) in catalogue order."""
    catalogue = metric_catalogue.table(metrics.sparkSession)
    rows = metrics.join(F.broadcast(catalogue.select("code", "ordinal")), "code", "left")
    one = F.struct(F.coalesce("ordinal", F.lit(1 << 20)).alias("ordinal"), "code", shown(F.col("value"), F.col("is_integral")).alias("value"))
    grouped = rows.groupBy("level", "entity_id", "parent_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return grouped.select("level", "entity_id", "parent_id", F.map_from_entries(F.transform("m", lambda x: F.struct(x["code"], x["value"]))).alias("metrics"))


def _in_order(*columns: str | Column) -> Column:
    """Structs sorted by their first field."""
    return F.array_sort(F.collect_list(F.struct(*columns)), lambda a, b: F.when(a["__key"] < b["__key"], -1).when(a["__key"] > b["__key"], 1).otherwise(0))


def _without_key(column: str, fields: list[str]) -> Column:
    return F.transform(column, lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def packages(analysis: Analysis) -> DataFrame:
    """One row a package: packageName, metrics and classes with their methods, all in order of names and signatures."""
    rows = by_level(analysis.metrics)
    places = analysis.entities().withColumn("sourceLocation", F.struct("path", F.col("line").alias("startLine"), F.col("end_line").alias("endLine")))
    at = lambda level: rows.filter(F.col("level") == level).select("entity_id", "parent_id", "metrics")
    located = lambda level: at(level).join(places.filter(F.col("level") == level).drop("level"), "entity_id")
    bare = F.regexp_extract("signature", r"^([^(]*)", 1)
    fields = ["signature", "methodName", "parameterCount", "sourceLocation", "metrics"]
    methods = located("method").groupBy(F.col("parent_id").alias("owner")).agg(_in_order(F.col("signature").alias("__key"), "signature", bare.alias("methodName"), F.col("params").alias("parameterCount"), "sourceLocation", "metrics").alias("methods"))
    methods = methods.select("owner", _without_key("methods", fields).alias("methods"))
    classes = located("class").join(methods, F.col("entity_id") == F.col("owner"), "left")
    simple = F.element_at(F.split("name", r"\."), -1)
    empty = F.coalesce("methods", F.array().cast(dict(methods.dtypes)["methods"]))
    fields = ["className", "qualifiedName", "sourcePath", "sourceLocation", "metrics", "methods"]
    nested = classes.groupBy(F.col("parent_id").alias("package")).agg(_in_order(F.col("name").alias("__key"), simple.alias("className"), F.col("name").alias("qualifiedName"), F.col("path").alias("sourcePath"), "sourceLocation", "metrics", empty.alias("methods")).alias("classes"))
    return at("package").join(nested.select("package", _without_key("classes", fields).alias("classes")), F.col("entity_id") == F.col("package"), "left").select(F.col("entity_id").alias("packageName"), "metrics", "classes")


def diagnostic_order(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics in their total order: severity (errors first), code, message, path and lines."""
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return diagnostics.orderBy(rank, "code", "message", F.col("path").asc_nulls_first(), F.col("start_line").asc_nulls_first(), F.col("end_line").asc_nulls_first())


def diagnostics(analysis: Analysis) -> DataFrame:
    """(severity, code, message, path, start_line, end_line)."""
    code = F.col("kind")
    level = F.when(code.startswith("PARSE") | code.startswith("ROOT"), "ERROR").when(code == "MODULE_DESCRIPTOR", "INFO").otherwise("WARNING")
    return analysis.tables["diagnostics"].select(level.alias("severity"), code.alias("code"), F.coalesce("name", code).alias("message"), "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))


def diagnostic_counts(rows: DataFrame) -> DataFrame:
    """One row: whether there are any diagnostics, warnings and errors."""
    return rows.agg((F.count("*") > 0).alias("any"), (F.count_if(F.col("severity") == "WARNING") > 0).alias("warnings"), (F.count_if(F.col("severity") == "ERROR") > 0).alias("errors"))


def _one(df: DataFrame, column: Column) -> str | None:
    row = df.agg(F.to_json(F.struct(column.alias("v"))).alias("v")).first()
    return row and row.v


def analysis(found: Analysis, name: str = "project") -> str:
    """The analysis report of a project of ordinary size."""
    project = by_level(found.metrics.filter("level = 'project'")).select(F.to_json(F.struct("metrics")).alias("v")).first()
    nested = json.loads(_one(packages(found), _in_order(F.col("packageName").alias("__key"), "packageName", "metrics", "classes")))["v"]
    for package in nested:
        del package["__key"]
    order = diagnostic_order(diagnostics(found)).collect()
    told = [{"code": r.code, "severity": r.severity, "message": r.message, "location": {"path": r.path, "startLine": r.start_line, "endLine": r.end_line} if r.path else None} for r in order]
    metrics = json.loads(project.v)["metrics"] if project else {}
    coverage = found.symbols.coverage().first().coverage
    return json.dumps({"project": {"projectName": name, "resolutionCoverage": None if coverage is None else round(coverage, 4), "metrics": metrics, "packages": nested}, "diagnostics": told}, indent=2)


def detection(matches: DataFrame, rules: list[tuple[str, str]], problems: DataFrame) -> str:
    """The detection report: ``matches`` (level, rule, entity_id, path, severity, violations), ``rules`` (level, rule) in order, ``problems`` (level, rule, code, problem)."""
    spark = matches.sparkSession
    listed = spark.createDataFrame([(level, rule, i) for i, (level, rule) in enumerate(rules)], "level string, rule string, ix int")
    held = matches.join(listed, ["level", "rule"])
    per_rule = held.groupBy("level", "rule", "ix").agg(F.count("*").alias("matchCount"), F.array_sort(F.collect_list(F.struct("entity_id", "path", "violations", "severity"))).alias("matches"))
    found = {(r["level"], r["rule"]): json.loads(r.j) for r in per_rule.select("level", "rule", F.to_json(F.struct("matchCount", "matches")).alias("j")).collect()}  # a row for each rule
    blocks = {f"{level}Rules": [{"name": rule, **found.get((level, rule), {"matchCount": 0, "matches": []})} for at, rule in rules if at == level] for level in ("class", "method", "package")}
    odd = [r.asDict() for r in problems.collect()]  # a row for each condition at most
    views = {view: [r.asDict() for r in by_entity(held, level).collect()] for view, level in (("byClass", "class"), ("byPackage", "package"), ("byMethod", "method"))}
    counts = held.agg(F.count("*").alias("totalFindings"), F.count_distinct(F.when(F.col("level") == "class", F.col("entity_id"))).alias("affectedClasses"), F.count_distinct(F.when(F.col("level") == "package", F.col("entity_id"))).alias("affectedPackages")).first()
    summary = {f"{level}Rules": {"total": sum(at == level for at, _ in rules), "matched": sum(at == level and (at, rule) in found for at, rule in rules), "problems": [{k: p[k] for k in ("rule", "code", "problem")} for p in odd if p["level"] == level]} for level in ("class", "method", "package")}
    return json.dumps({"status": "COMPLETED", **blocks, **views, "summary": summary | counts.asDict()}, indent=2)


def by_entity(matches: DataFrame, level: str) -> DataFrame:
    """(entity_id, worst, rules) of the matches (level, rule, ix, entity_id, severity) of one level, in the report's order.

    Classes and packages come with the worst first, methods, by the report's own definition, with the least severe first; rules by their order.
    """
    rank = severity_rank(F.col("severity"))
    rules = F.transform(F.array_sort(F.collect_list(F.struct("ix", "rule"))), lambda x: x["rule"])
    rows = matches.filter(F.col("level") == level).groupBy("entity_id").agg(F.max(rank).alias("rank"), rules.alias("rules"))
    worst = F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low")
    first = F.col("rank").asc() if level == "method" else F.col("rank").desc()
    return rows.orderBy(first, "entity_id").select("entity_id", worst.alias("worst"), "rules")


def gate(found) -> str:
    """The gate report: verdict, comparison, violations and warnings, together and by file."""
    rows = lambda df: [r.asDict() for r in df.orderBy(severity_rank(F.col("severity")).desc_nulls_last(), F.col("magnitude").desc_nulls_last(), "code", "file", "entity_id", "type").select("file", "entity_id", "code", "type", "base_value", "value", "severity", "magnitude").collect()]
    violations = rows(found.violations)
    warnings = [r.asDict() for r in found.warnings.orderBy("file", "entity_id", "code", "type").select("file", "entity_id", "code", "type", "base_value", "value", "severity", "magnitude").collect()]
    files = sorted({r["file"] for r in (*violations, *warnings)})
    by_file = [{"file": f, "violations": [r for r in violations if r["file"] == f], "warnings": [r for r in warnings if r["file"] == f]} for f in files]
    plan = found.plan
    comparison = {"mode": plan.mode, "requestedBase": plan.requested, "baseSha": plan.base, "headSha": plan.head, "mergeBaseSha": plan.merge_base, "beforeDigest": found.before_digest, "afterDigest": found.after_digest, "subjectFiles": sorted(r.path for r in found.subjects.collect())}
    issues = [r.asDict() for r in found.issues.orderBy(F.col("required").desc(), F.col("file").asc_nulls_first(), F.col("code").asc_nulls_first(), "reason").collect()]
    return json.dumps({"status": found.status()[0], "base": plan.requested, "changedFiles": found.subjects.count(), "violations": violations, "warnings": warnings, "byFile": by_file, "comparison": comparison, "analysis": {"complete": not any(i["required"] for i in issues), "issues": issues}}, indent=2)


def finding_rows(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding, in order: identity, verdict, evidence with the limits that apply, and disposition."""
    from quarry.operators.findings import ordered

    evidence = F.transform("evidence", lambda e: F.struct(e["code"].alias("metric"), e["before"].alias("before"), e["after"].alias("after"), F.struct(e["min"].alias("min"), e["max"].alias("max")).alias("limit")))
    entity = F.struct("path", F.col("name").alias("class"), "signature")
    return ordered(findings).select(F.to_json(F.struct(
        F.col("rule").alias("ruleId"), F.col("version").alias("ruleVersion"), "title", entity.alias("entity"), "fingerprint", "severity", "maturity", "role", F.col("status").alias("evaluationStatus"), "lifecycle",
        evidence.alias("evidence"), "disposition", F.col("reason").alias("dispositionReason"), F.col("blocking").alias("blocks"),
    )).alias("value"))


def findings(found, k: int | None = None) -> str:
    """The findings report; with ``k`` the compact view, without unchanged debt."""
    from quarry.operators import findings as FN

    counts = FN.summary(found.findings).first().asDict()
    rows = FN.compact(found.findings, k).drop("shown_of", "dropped") if k else found.findings
    status, code = found.status()
    return json.dumps({"schemaVersion": 2, "status": status, "exitCode": code, "policyDigest": found.policy_digest, "summary": counts, "findings": [json.loads(r.value) for r in finding_rows(rows).collect()]}, indent=2)


def sarif(findings: DataFrame, entities: DataFrame) -> str:
    """SARIF 2.1.0 of the reportable findings, with rules and regions; ``entities`` (path, name, signature, line, end_line)."""
    from quarry.operators.findings import ordered, reportable

    sign = lambda d: F.coalesce(d["signature"], F.lit(""))
    rows = ordered(reportable(findings))
    lines = entities.select("path", "name", F.col("signature").alias("__s"), "line", "end_line").dropDuplicates(["path", "name", "__s"])
    on = (rows["path"] == lines["path"]) & (rows["name"] == lines["name"]) & (sign(rows) == F.coalesce(lines["__s"], F.lit("")))
    joined = rows.join(lines, on, "left").select(rows["*"], "line", "end_line")
    results, rules = [], {}
    for r in ordered(joined).collect():
        rules.setdefault(r.rule, {"id": r.rule, "name": r.title, "shortDescription": {"text": r.title}, "defaultConfiguration": {"level": r.severity}})
        region = {"region": {"startLine": r.line, "endLine": r.end_line}} if r.line else {}
        results.append({"ruleId": r.rule, "level": "error" if r.blocking else "warning", "message": {"text": f"{r.title}: {r.name}{'#' + r.signature if r.signature else ''}"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.path}, **region}}], "partialFingerprints": {"quarry/v1": r.fingerprint}, "properties": {"lifecycle": r.lifecycle, "disposition": r.disposition}})
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "quarry", "rules": list(rules.values())}}, "results": results}]}, indent=2)


def write_text(text: str, path: str) -> None:
    """``text`` to ``path`` in one step: a reader never sees a part of it."""
    import os
    import tempfile

    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as f:
        f.write(text)
    os.replace(f.name, path)
