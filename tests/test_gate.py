"""The gate over a repository made for the test, in all three modes."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.operators import findings as FN
from quarry.plans import gate, java_metrics
from quarry.sinks import documents
from quarry.sources import catalogue_rules, config, revisions

ROOT = "src/main/java/"


def method(name, branches):
    return f"    int {name}(int a) {{\n" + "".join(f"        if (a > {i}) {{ a++; }}\n" for i in range(branches)) + "        return a;\n    }\n"


def unit(name, *methods):
    return f"package p;\nclass {name} {{\n{''.join(methods)}}}\n"


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    repo = tmp_path_factory.mktemp("repo")
    git(repo, "init", "-q", "-b", "main")
    for name, text in {"Old": unit("Old", method("branchy", 20), method("calm", 2)), "Moved": unit("Moved", method("busy", 18)), "Gone": unit("Gone", method("gone", 17)), "Same": unit("Same", method("same", 19))}.items():
        path = repo / f"{ROOT}p/{name}.java"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "one")
    (repo / f"{ROOT}p/Old.java").write_text(unit("Old", method("branchy", 26), method("calm", 18)))
    (repo / f"{ROOT}q").mkdir()
    git(repo, "mv", f"{ROOT}p/Moved.java", f"{ROOT}q/Moved.java")
    git(repo, "rm", "-q", f"{ROOT}p/Gone.java")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "two")
    (repo / f"{ROOT}p/Staged.java").write_text(unit("Staged", method("fresh", 16)))
    git(repo, "add", ".")
    (repo / f"{ROOT}p/Untracked.java").write_text(unit("Untracked", method("fresh", 16)))
    return str(repo)


POLICY = catalogue_rules.policy({"rules": {"MT-M001": {"mode": "error"}}})


def lives(found):
    return {(r.name, r.signature): (r.lifecycle, r.disposition, r.blocking) for r in found.findings.filter("rule = 'MT-M001'").collect()}


def test_committed(spark, repo):
    found = gate.run(spark, repo, "HEAD~1", "committed", rules=POLICY, day="2026-01-01")
    got = lives(found)
    assert got["p.Old", "branchy(int)"] == ("WORSENED", "ACTIVE", True) and got["p.Old", "calm(int)"] == ("INTRODUCED", "ACTIVE", True)
    assert got["p.Moved", "busy(int)"] == ("EXISTING", "ACTIVE", False)  # moved with its name, so it isn't new
    assert got["p.Same", "same(int)"] == ("EXISTING", "EXISTING", False)  # outside the changed set
    assert ("p.Gone", "gone(int)") not in got  # its file is no longer read, so nothing says it was resolved
    kinds = {(r.entity_id, r.code, r.type) for r in found.violations.collect()}
    assert ("p.Old#branchy(int)", "CC", "GROWTH_BUDGET") in kinds and ("p.Old#calm(int)", "CC", "GROWTH_BUDGET") in kinds
    assert found.status() == ("FAILED", 1)
    report = json.loads(documents.gate(found))
    assert report["status"] == "FAILED" and report["comparison"]["mode"] == "committed" and f"{ROOT}p/Old.java" in report["comparison"]["subjectFiles"]
    told = json.loads(documents.findings(found))
    assert told["summary"]["reconciled"] and told["findings"][0]["blocks"] and told["summary"]["blocking"] == 2
    assert len(json.loads(documents.findings(found, 1))["findings"]) == 1
    sarif = json.loads(documents.sarif(found.findings, spark.createDataFrame([(f"{ROOT}p/Old.java", "p.Old", "branchy(int)", 3, 9)], "path string, name string, signature string, line int, end_line int")))
    assert sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "endLine": 9}
    assert {r["ruleId"] for r in sarif["runs"][0]["results"]} <= {r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]}


def test_staged_and_worktree(spark, repo):
    names = {}
    for mode in ("staged", "worktree"):
        plan = revisions.plan(spark, repo, "HEAD", mode)
        names[mode] = {r.path.rpartition("/")[2] for r in gate.subject_paths(plan, []).collect()}
    assert names == {"staged": {"Staged.java"}, "worktree": {"Staged.java", "Untracked.java"}}
    found = gate.run(spark, repo, "HEAD", "worktree", project=config.Project(thresholds={"CC": {"max": 30}}), rules=POLICY, advisory=True)
    assert lives(found)["p.Untracked", "fresh(int)"] == ("NEW_ENTITY", "ACTIVE", False) and found.status()[0] == "PASSED"
    with pytest.raises(ValueError):
        revisions.plan(spark, repo, "HEAD", "someday")


def test_nothing_changed(spark, repo):
    found = gate.run(spark, repo, "HEAD", "committed", rules=POLICY)
    assert found.status() == ("PASSED", 0) and found.subjects.isEmpty()


ENTITY = "path string, name string, signature string"


@pytest.fixture(scope="module")
def rows(spark):
    measures = f"{ENTITY}, code string, value double"
    base = spark.createDataFrame([("a", "A", "m()", "CC", 20.0), ("a", "A", "n()", "CC", 18.0), ("old", "B", "m()", "CC", 17.0), ("a", "A", "nan()", "CC", float("nan"))], measures)
    now = spark.createDataFrame([("a", "A", "m()", "CC", 30.0), ("a", "A", "n()", "CC", 19.0), ("new", "B", "m()", "CC", 17.0), ("a", "A", "nan()", "CC", 20.0), ("a", "A", "late()", "CC", 40.0)], measures)
    moves = spark.createDataFrame([("old", "new")], "old_path string, new_path string")
    pairs = FN.correspond(FN.wide(base, ["CC"]), FN.wide(now, ["CC"]), moves)
    return FN.evaluate(pairs, [r for r in POLICY.rules() if r["rule"] == "MT-M001"], [("X", ".*")])


def test_lifecycles_of_rows(rows):
    found = {(r.name, r.signature): r for r in rows.collect()}
    assert {k: v.lifecycle for k, v in found.items()} == {("A", "m()"): "WORSENED", ("A", "n()"): "EXISTING", ("B", "m()"): "EXISTING", ("A", "nan()"): "COMPARISON_UNAVAILABLE", ("A", "late()"): "NEW_ENTITY"}
    assert found["B", "m()"].previous_fingerprint not in (None, found["B", "m()"].fingerprint) and found["A", "m()"].previous_fingerprint is None


def test_suppressions_need_rule_and_entity(spark, rows):
    listed = spark.createDataFrame([(0, "MT-M001", "a", "A", "m()", "over", "2025-01-01"), (1, "MT-M001", "a", "A", "m()", "first", "2026-06-01"), (2, "MT-M001", "a", "A", "m()", "second", None), (3, "MT-M002", "a", "A", "late()", "other rule", None)], f"ix int, rule string, {ENTITY}, reason string, expires string").withColumn("expires", F.to_date("expires"))
    found = {r.signature: (r.disposition, r.reason, r.blocking) for r in FN.suppress(rows, listed, F.lit("2026-01-01").cast("date")).filter("name = 'A'").collect()}
    assert found["m()"] == ("SUPPRESSED", "first", False) and found["late()"] == ("ACTIVE", None, True)


def test_baseline_by_fingerprint_and_earlier_fingerprint(spark, rows):
    accepted = FN.baseline_of(rows)
    moved = rows.filter("name = 'B'").first()
    earlier = accepted.filter("name = 'A'").unionByName(accepted.filter("name = 'B'").withColumn("fingerprint", F.lit(moved.previous_fingerprint)))
    worse = earlier.withColumn("accepted", F.when(F.col("signature") == "late()", F.create_map(F.lit("CC"), F.lit(30.0))).otherwise(F.col("accepted")))
    rules = POLICY.rules()
    found = {(r.name, r.signature): (r.disposition, r.reason) for r in FN.accept(rows, worse, rules).collect()}
    assert found["A", "m()"][0] == found["B", "m()"][0] == "ACCEPTED" and found["A", "late()"] == ("ACTIVE", "worse than accepted")
    assert FN.stale(worse.unionByName(worse.limit(1).withColumn("fingerprint", F.lit("x"))), rows).count() == 1
    again = FN.deduplicated(rows.unionByName(rows))
    assert again.count() == rows.count()


def test_order_and_compact_view(rows):
    order = [(r.name, r.signature) for r in FN.ordered(rows).collect()]
    assert order == [("A", "late()"), ("A", "m()"), ("A", "n()"), ("A", "nan()"), ("B", "m()")]
    top = FN.compact(rows, 1).collect()
    assert [(r.signature, r.shown_of, r.dropped) for r in top] == [("late()", 3, 2)]


def test_analysis_document(spark, tmp_path):
    (tmp_path / "A.java").write_text("package p;\nclass A { int f; int get(int a) { return a; } }\n")
    found = java_metrics.analyze(spark, [str(tmp_path)])
    report = json.loads(documents.analysis(found, "demo"))
    only = report["project"]["packages"][0]["classes"][0]
    assert (only["className"], only["metrics"]["WMC"], only["metrics"]["TCC"], only["metrics"]["NOM"]) == ("A", "1", "0.0", "1")
    assert (only["methods"][0]["signature"], only["methods"][0]["methodName"], only["methods"][0]["parameterCount"], only["methods"][0]["metrics"]["CC"]) == ("get(int)", "get", 1, "1")
    assert report["project"]["metrics"]["PNOCC"] == "1" and report["diagnostics"] == [] and len(report["project"]["metrics"]) == 29
