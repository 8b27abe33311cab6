import json
import subprocess

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry.operators import scope
from quarry.plans import catalogue, java_metrics
from quarry.sinks import reports
from quarry.sources import catalogue_rules, evaluation, java_source, revisions


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["entity_id", "code", "value", "min", "max", "overshoot", "severity"] and rows.count() > 0


def test_context_without_roots(spark):
    paths = spark.createDataFrame([("a/b.java",), ("c.java",)], "path string")
    roots = spark.createDataFrame([], "root string")
    assert {r.inside for r in scope.in_context(paths, roots).collect()} == {True}
    assert {r.path: r.inside for r in scope.in_context(paths, spark.createDataFrame([("a/",)], "root string")).collect()} == {"a/b.java": True, "c.java": False}


@pytest.mark.parametrize(("flag", "disposition", "life", "status", "advisory", "expected"), [(True, "ACTIVE", "WORSENED", "MATCH", False, True), (True, "ACTIVE", "EXISTING", "MATCH", False, False), (True, "SUPPRESSED", "INTRODUCED", "MATCH", False, False), (True, "ACTIVE", "INTRODUCED", "MATCH", True, False)])
def test_blocking(spark, flag, disposition, life, status, advisory, expected):
    row = spark.createDataFrame([(flag, disposition, life, status)], "f boolean, d string, l string, s string")
    assert row.select(scope.blocking(F.col("f"), F.col("d"), F.col("l"), F.col("s"), advisory)).first()[0] is expected


def test_tool_reports(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"files": [{"filename": "A.java", "violations": [{"rule": "R", "beginline": 3}, {"rule": "Q", "beginline": 4}]}]}))
    (tmp_path / "clean.json").write_text(json.dumps({"files": []}))
    (tmp_path / "partial.json").write_text(json.dumps({"files": [], "processingErrors": ["x"]}))
    found = sorted((r.report, r.status, r.rule) for r in evaluation.tool_findings(spark, str(tmp_path)).collect())
    assert found == [("good.json", "ok", "Q"), ("good.json", "ok", "R"), ("partial.json", "failed", None)] or [f[1:] for f in found] == [("ok", "Q"), ("ok", "R"), ("failed", None)]


def test_generated_corpus_is_analysed(spark):
    first, again = (sorted(map(tuple, evaluation.corpus(spark, 30).collect())) for _ in range(2))
    assert first == again and len({p for p, _ in first}) == 30
    tables = java_source.tables(evaluation.corpus(spark, 30))
    assert tables["diagnostics"].count() == 0
    assert {r.CC for r in java_metrics.methods(tables).collect()} <= set(range(2, 9))


def test_rule_catalogue(spark):
    rules, conditions = catalogue_rules.rules(spark), catalogue_rules.conditions(spark)
    overrides = spark.createDataFrame([("MT-M001", None, "block", None, None), ("MT-M001", "CC", None, 20.0, None)], "rule string, code string, mode string, min double, max double")
    new_rules, new_conditions = catalogue_rules.effective(rules, conditions, overrides)
    assert {r.rule: r.mode for r in new_rules.collect()}["MT-M001"] == "block"
    assert {(r.rule, r.code): r.min for r in new_conditions.collect()}["MT-M001", "CC"] == 20.0 and new_conditions.count() == conditions.count()
    for overrides, suppressions in (([{"rule": "X"}], []), ([{"rule": "MT-M001"}] * 2, []), ([{"rule": "MT-C001", "mode": "block"}], []), ([], [{"rule": "X"}])):
        with pytest.raises(catalogue_rules.PolicyError):
            catalogue_rules.check(overrides, suppressions)


def test_index_working_tree_and_classpath(spark, tmp_path):
    repo = tmp_path / "repo"
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    (repo / "A.java").write_text("class A {}")
    (repo / "B.java").write_text("class B {}")
    (repo / "L.java").symlink_to("A.java")
    subprocess.run(["git", "-C", str(repo), "add", "A.java", "L.java"], check=True)
    assert [r.path for r in revisions.index(spark, str(repo)).collect()] == ["A.java"]
    assert [r.path for r in revisions.working_tree(spark, str(repo)).collect()] == ["A.java", "B.java"]
    kinds = {r.path: r.kind for r in revisions.classpath(spark, [str(repo), str(tmp_path / "none"), str(repo / "A.java")]).collect()}
    assert list(kinds.values()) == ["source-dir", "bad", "bad"]


def test_html_and_baseline(spark, tmp_path):
    findings = spark.createDataFrame([("R<1>", "a.B", "high", "f1", "p1")], "rule string, entity_id string, severity string, fingerprint string, policy string")
    assert "R&lt;1&gt;" in reports.html(findings)
    reports.write_baseline(findings, str(tmp_path / "b"))
    assert reports.read_baseline(spark, str(tmp_path / "b"), "p1").count() == 1
    with pytest.raises(ValueError):
        reports.read_baseline(spark, str(tmp_path / "b"), "p2")
