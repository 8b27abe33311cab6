"""Truth tables of the policy operators on small rows."""

import datetime
import json
import math
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.functions import formulas
from quarry.functions import value as V
from quarry.operators import graph, policy, rollup, windows
from quarry.sinks import reports
from quarry.sources import config, revisions
from quarry.streaming import policy_stream


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "expected"), [(7, 2, 3), (-7, 2, -3), (7, -2, -3), (1, 0, None)])
def test_truncated_ratio(spark, a, b, expected):
    assert one(spark, V.truncated_ratio(F.col("a"), F.col("b")), a=a, b=b) == expected


@pytest.mark.parametrize("x", [0, 1, 2**31 - 1, 2**31, 2**32 + 5, -(2**31) - 1, 123456789 * 987654])
def test_wrap32(spark, x):
    assert one(spark, V.wrap32(F.col("x")), x=x) == (x + 2**31) % 2**32 - 2**31


@pytest.mark.parametrize(("value", "low", "high", "expected"), [(3.0, None, 0.0, "low"), (25.0, None, 10.0, "high"), (12.0, None, 10.0, "medium"), (11.0, None, 10.0, "low"), (4.0, 10.0, None, "high"), (0.0, 10.0, None, "low")])
def test_severity(spark, value, low, high, expected):
    row = spark.createDataFrame([(value, low, high)], "v double, l double, h double")
    assert row.select(V.severity(F.col("v"), F.col("l"), F.col("h"))).first()[0] == expected


@pytest.mark.parametrize(("value", "shown"), [(1.0, "1.0"), (1.00001, "1.0"), (0.03125, "0.0312"), (0.5, "0.5"), (None, "N/A")])
def test_display(spark, value, shown):
    assert spark.createDataFrame([(value,)], "v double").select(V.display(F.col("v"))).first()[0] == shown


def test_formulas(spark):
    row = spark.createDataFrame([(3, 4, 10, 12)], "n1 long, n2 long, o long, p long")
    h = row.select(*(v.alias(n) for n, v in formulas.halstead(*(F.col(c) for c in ("n1", "n2", "o", "p"))).items())).first()
    assert h.volume == pytest.approx(22 * math.log2(7)) and h.difficulty == pytest.approx(4.5) and h.length == pytest.approx(2 / 3 * 4 / 12)
    assert h.effort == pytest.approx(3 * 12 * 22 * math.log(7) / 8) and h.errors == pytest.approx(h.effort / 3000)
    mi = lambda *x: one(spark, formulas.maintainability(F.col("a"), F.col("b"), F.col("c")), a=x[0], b=x[1], c=x[2])
    assert mi(100.0, 5.0, 20.0) == pytest.approx((171 - 5.2 * math.log(100) - 0.23 * math.log(5) - 16.2 * math.log(20)) * 100 / 171)
    assert mi(0.0, 5.0, 20.0) == 0 and mi(1e30, 5.0, 1e30) == 0


def test_three_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), ("c", 2)], "k string, v long")
    got = {r.k: (r.x, r.y, r.z) for r in df.groupBy("k").agg(rollup.sum_or_absent(F.col("v")).alias("x"), rollup.sum_or_zero(F.col("v")).alias("y"), rollup.sum_poisoned(F.col("v"), F.col("v").isNull()).alias("z")).collect()}
    assert got == {"a": (1, 1, None), "b": (None, 0, None), "c": (2, 2, 2)}


def test_closure_and_depth_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    assert graph.closure(edges).count() == 10  # a cycle reaches itself
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    parents = spark.createDataFrame([(2, 1), (3, 2), (4, 99)], "node long, parent long")
    assert {r.node: r.depth for r in graph.depth(nodes, parents).collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 1}


def test_first_match_and_caps(spark):
    df = spark.createDataFrame([("src/test/A",), ("gen/B",), ("x",)], "p string")
    assert [r[0] for r in df.select(windows.first_match(F.col("p"), [("TEST", ".*test.*"), ("GEN", "(?:src|gen).*")], "UNKNOWN")).collect()] == ["TEST", "GEN", "UNKNOWN"]
    rows = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "k long, i long")
    assert windows.capped(rows, ["k"], [F.col("i")], 3).count() == 4 and windows.omitted(rows, ["k"], 3).collect()[0].omitted == 2


@pytest.mark.parametrize(
    ("base", "now", "worse", "expected"),
    [(None, "MATCH", False, "NEW_ENTITY"), (None, "NONMATCH", False, None), ("NONMATCH", "MATCH", False, "INTRODUCED"), ("MATCH", "NONMATCH", True, "RESOLVED"), ("MATCH", "MATCH", True, "WORSENED"), ("MATCH", "MATCH", False, "EXISTING"), ("UNAVAILABLE", "MATCH", False, "COMPARISON_UNAVAILABLE"), ("MATCH", "UNAVAILABLE", True, "COMPARISON_UNAVAILABLE"), ("NONMATCH", "NONMATCH", True, None)],
)
def test_lifecycle(spark, base, now, worse, expected):
    row = spark.createDataFrame([(base, now, worse)], "b string, n string, w boolean")
    assert row.select(policy.lifecycle(F.col("b"), F.col("n"), F.col("w"))).first()[0] == expected


@pytest.mark.parametrize(
    ("before", "after", "kind", "max_only", "expected"),
    [((10, 5), (31, 5), "RISES_BY", (), True), ((10, 5), (29, 5), "RISES_BY", (), False), ((None, 5), (31, 9), "RISES_BY", (), False), ((31, 5), (10, 5), "RISES_BY", ("A",), True), ((10, 5), (31, 4), "RISES_BY_WHILE_OTHERS_HOLD", (), False), ((10, 5), (31, 5), "RISES_BY_WHILE_OTHERS_HOLD", (), True), ((10, 5), (31, 6), "ALL_RISE_BY", (), False), ((10, 5), (31, 7), "ALL_RISE_BY", ("A",), True)],
)
def test_worsened(spark, before, after, kind, max_only, expected):
    row = spark.createDataFrame([(*before, *after)], "a0 int, b0 int, a1 int, b1 int")
    rose = policy.worsened({"A": F.col("a0"), "B": F.col("b0")}, {"A": F.col("a1"), "B": F.col("b1")}, {"A": 20, "B": 2}, kind, frozenset(max_only), ("A", "B"))
    assert row.select(rose).first()[0] is expected


def test_gate_and_baseline(spark):
    schema = "entity_id string, code string, value double"
    base = spark.createDataFrame([("a", "WMC", 10.0), ("b", "WMC", 50.0), ("c", "WMC", 9.0), ("d", "NOM", 3.0)], schema)
    now = spark.createDataFrame([("a", "WMC", 40.0), ("b", "WMC", 51.0), ("c", "WMC", 9.0), ("d", "NOM", 3.5), ("e", "WMC", 70.0)], schema)
    limits = spark.createDataFrame([("WMC", None, 30.0), ("NOM", None, 10.0)], "code string, min double, max double")
    found = policy.gate(base, now, limits, spark.createDataFrame([("WMC", 20.0)], "code string, budget double"), ["NEW_VIOLATION"])
    got = {(r.entity_id, r.type): (r.severity, r.magnitude, r.blocking) for r in found.collect()}
    assert got == {("a", "THRESHOLD_CROSSING"): ("medium", 10.0, False), ("a", "GROWTH_BUDGET"): ("medium", 30.0, False), ("b", "WORSENED"): (None, None, False), ("d", "WORSENED"): (None, None, False), ("e", "NEW_VIOLATION"): ("high", 40.0, True)}
    bounds = "entity_id string, code string, value double, min double, max double"
    new = spark.createDataFrame([("a", "X", 9.0, None, 5.0), ("b", "X", 7.0, None, 5.0), ("c", "X", 6.0, None, 5.0)], bounds)
    old = spark.createDataFrame([("b", "X", 6.0, None, 5.0), ("c", "X", 6.0, None, 5.0), ("d", "X", 6.0, None, 5.0)], bounds)
    assert {r.entity_id: r.status for r in policy.baseline_compare(new, old).collect()} == {"a": "NEW_VIOLATION", "b": "DEGRADED", "c": "UNCHANGED", "d": "RESOLVED"}


def test_correspondence_and_manifest(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "path string, name string")
    moved = spark.createDataFrame([("old", "lost", 0), ("old", "new", 1)], "old_path string, new_path string, seq int")
    got = {(r.kind, r.path, r.name, r.base_path) for r in policy.correspondence(pairs([("p", "A"), ("old", "B"), ("gone", "C")]), pairs([("p", "A"), ("new", "B"), ("x", "D")]), moved).collect()}
    assert got == {("SAME", "p", "A", "p"), ("MOVED", "new", "B", "old"), ("ADDED", "x", "D", None), ("REMOVED", None, "C", "gone")}


def test_fingerprint_escapes(spark):
    row = spark.createDataFrame([('a"b\\c\n', "n", None)], "p string, n string, s string")
    import hashlib

    text = '["v1","R",1,"v1",' + json.dumps('a"b\\c\n') + ',"n",""]'
    assert row.select(policy.fingerprint(F.lit("R"), F.lit(1), F.col("p"), F.col("n"), F.col("s"))).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def test_config(spark, tmp_path):
    with pytest.raises(config.ConfigError):
        config.thresholds(spark, {"XX": {"max": 1}}, {"CC"})
    for bad in ({}, {"min": 3, "max": 1}, {"max": float("nan")}, {"max": True}):
        with pytest.raises(config.ConfigError):
            config.thresholds(spark, {"CC": bad}, {"CC"})
    (tmp_path / "t.json").write_text('{"CC": {"max": 3}}')
    rows = config.thresholds(spark, config.load(str(tmp_path / "t.json")), {"CC"})
    assert {r.code: r.max for r in config.profile(spark, "strict", rows).collect()}["CC"] == 3.0
    assert config.exclusions({"a": ["x", ["y"]], "b": "z"}) == ["x", "y", "z"]


def test_revisions(spark, tmp_path):
    repo = str(tmp_path / "repo")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", repo], check=True)
    (tmp_path / "repo/A.java").write_text("class A { int a; int b; int c; }\n")
    (tmp_path / "repo/n.txt").write_text("x")
    run("add", "."), run("commit", "-qm", "1")
    before = revisions.manifest(spark, repo).collect()
    run("mv", "A.java", "B.java"), run("commit", "-qm", "2")
    base, head = revisions.git(repo, "rev-parse", "HEAD~1").strip(), revisions.git(repo, "rev-parse", "HEAD").strip()
    assert [r.path for r in before] == ["A.java"] and [r.path for r in revisions.tree(spark, repo, head).collect()] == ["B.java"]
    assert [(r.old_path, r.new_path) for r in revisions.moves(revisions.changes(spark, repo, base, head)).collect()] == [("A.java", "B.java")]
    assert revisions.merge_base(repo, base, head) == base


def test_reports(spark, tmp_path):
    findings = spark.createDataFrame([("R", "a.B", "high", "f1"), ("R", "a.C", "low", "f2")], "rule string, entity_id string, severity string, fingerprint string")
    log = json.loads(reports.render("detect", "sarif", findings).first().value)
    assert log["version"] == "2.1.0" and [r["level"] for r in log["runs"][0]["results"]] == ["error", "note"]
    assert "… 1 more" in reports.markdown(findings, 1)
    metrics = spark.createDataFrame([("package", "p", None, "A", 0.5), ("class", "p.C", "p", "WMC", 3.0), ("method", "p.C#m()", "p.C", "CC", None)], "level string, entity_id string, parent_id string, code string, value double")
    tree = json.loads(reports.render("analyze", "json", metrics).first().value)
    assert tree["classes"][0]["methods"][0]["metrics"] == {"CC": "N/A"} and tree["metrics"] == {"A": "0.5"}
    reports.write_baseline(findings, str(tmp_path / "b"))
    for gaps in (0, 3):
        with pytest.raises(Exception):  # noqa: B017
            reports.write_baseline(findings, str(tmp_path / "b"), gaps)
    with pytest.raises(ValueError):
        reports.render("gate", "sarif", findings)


def test_stream(spark, tmp_path):
    rows = [("e", "CC", 9.0, datetime.datetime(2024, 1, 1)), ("f", "CC", 1.0, datetime.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, policy_stream.METRIC_SCHEMA).write.parquet(str(tmp_path / "in"))
    limits = spark.createDataFrame([("CC", None, 5.0)], "code string, min double, max double")
    policy_stream.start(spark, str(tmp_path / "in"), limits, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.entity_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["e"]
