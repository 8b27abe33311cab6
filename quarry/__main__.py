"""Command line: ``python -m quarry analyze|validate|detect ROOT... [options]`` and ``python -m quarry gate REPOSITORY --base REF [options]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.value import severity_of
from quarry.operators import policy
from quarry.plans import gate, java_metrics
from quarry.session import local_session
from quarry.sinks import documents, reports
from quarry.sources import catalogue_rules, config, metric_catalogue


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("command", choices=["analyze", "validate", "detect", "gate"])
    p.add_argument("roots", nargs="+", help="source folders or files; for gate one repository")
    p.add_argument("--config", help="project configuration; without it the nearest one above the first root is used, if any")
    p.add_argument("--exclude", action="append", default=[], help="regular expression over dotted names; may be repeated")
    p.add_argument("--metric", action="append", default=[], help="code or name of a metric to report; may be repeated")
    p.add_argument("--thresholds", help="JSON or YAML file; without it the configuration or the profile is used")
    p.add_argument("--profile", choices=sorted(config.PROFILES))
    p.add_argument("--rules", help="JSON or YAML file of class rules (detect)")
    p.add_argument("--base", help="revision to compare with (gate)")
    p.add_argument("--mode", choices=config.MODES, help="what is compared (gate)")
    p.add_argument("--baseline", help="folder of accepted findings (gate)")
    p.add_argument("--write-baseline", help="folder to write the accepted findings to (gate)")
    p.add_argument("--advisory", action="store_true", help="findings of rules never block (gate)")
    p.add_argument("--format", default="json", choices=["json", "lines", "findings", "compact", "sarif"])
    p.add_argument("--output", help="file, or with lines a folder, for the report; without it the report is printed")
    return p


def _emit(report: str | DataFrame, output: str | None) -> None:
    if isinstance(report, str):
        documents.write_text(report + "\n", output) if output else print(report)
    elif output:
        report.write.mode("errorifexists").text(output)
    else:
        for row in report.toLocalIterator():
            print(row.value)


def _detect(spark: SparkSession, found: java_metrics.Analysis, rules: dict[str, list[dict]]) -> tuple[DataFrame, list[tuple[str, str]], DataFrame]:
    """Matches, rules in order, and problems of combination rules of all levels."""
    matches = problems = None
    names = metric_catalogue.table(spark).select("code")
    where = found.entities().select("level", "entity_id", "path")
    for level, listed in rules.items():
        conditions = config.rules(spark, listed)
        metrics = found.metrics.filter(F.col("level") == level)
        held = policy.satisfied_conditions(metrics, conditions).withColumn("level", F.lit(level)).join(where, ["level", "entity_id"], "left")
        held = held.select("level", "rule", "entity_id", "path", severity_of(F.col("excess")).alias("severity"), "violations")
        odd = policy.rule_problems(conditions, names).withColumn("level", F.lit(level))
        matches, problems = (held, odd) if matches is None else (matches.unionByName(held), problems.unionByName(odd))
    return matches, [(level, r["name"]) for level, listed in rules.items() for r in listed], problems


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    spark = local_session()
    project = config.project(args.config or config.discover(args.roots[0]))
    for key in project.unknown:
        print(f"{project.file}: {key} is no setting and was ignored", file=sys.stderr)
    exclude = (*args.exclude, *project.exclusions)
    if args.command == "gate":
        return _gate(p, args, spark, project)
    found = java_metrics.analyze(spark, args.roots, exclude)
    if args.metric:
        chosen = metric_catalogue.find(spark.createDataFrame([(m,) for m in args.metric], "name string"), metric_catalogue.table(spark))
        unknown = [r.name for r in chosen.filter("code is null").collect()]
        if unknown:
            p.error(f"unknown metric {', '.join(unknown)}")
        found.metrics = found.metrics.join(F.broadcast(chosen.select("code")), "code", "left_semi").select(*found.metrics.columns)
    metrics = found.metrics
    if args.command == "analyze":
        _emit(documents.analysis(found) if args.format == "json" else reports.json_lines(documents.packages(found)), args.output)
        return 0
    if args.command == "validate":
        known = {c for c, _ in metric_catalogue.codes()}
        limits = config.thresholds(spark, config.load(args.thresholds), known) if args.thresholds else project.limits(spark, known, args.profile)
        checked = policy.violations(metrics.filter("level = 'class'"), limits if limits is not None else config.profile(spark, "standard"))
        _emit(reports.render("validate", "json", checked), args.output)
        return int(not checked.filter("not passed").isEmpty())
    rules = {"class": config.load(args.rules)} if args.rules else project.rules
    if not rules:
        p.error("detect needs --rules or rules in the configuration")
    matches, listed, problems = _detect(spark, found, rules)
    _emit(documents.detection(matches, listed, problems) if args.format == "json" else reports.json_lines(matches), args.output)
    return 0


def _gate(p: argparse.ArgumentParser, args: argparse.Namespace, spark: SparkSession, project: config.Project) -> int:
    if not args.base or len(args.roots) != 1:
        p.error("gate needs one repository and --base")
    project.exclusions = [*project.exclusions, *args.exclude]
    project.profile = args.profile or project.profile
    rules = catalogue_rules.policy(project.policy) if project.policy else catalogue_rules.Policy()
    accepted = reports.read_accepted(spark, args.baseline, rules.digest()) if args.baseline else None
    found = gate.run(spark, args.roots[0], args.base, args.mode, project, rules, baseline=accepted, advisory=args.advisory)
    if args.write_baseline:
        reports.write_accepted(found.findings, args.write_baseline, rules.digest(), found.issues.filter("required").count())
    if args.format == "sarif":
        report = documents.sarif(found.findings, found.findings.select("path", "name", "signature").selectExpr("*", "cast(null as int) as line", "cast(null as int) as end_line"))
    elif args.format in ("findings", "compact"):
        report = documents.findings(found, 20 if args.format == "compact" else None)
    else:
        report = documents.gate(found)
    _emit(report, args.output)
    return found.status()[1]


if __name__ == "__main__":
    sys.exit(main())
