import json

import pytest

from quarry import __main__ as cli
from quarry.sinks import reports


@pytest.fixture
def source(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "A.java").write_text("package p;\nclass A { int f; int get(int a) { if (a > 1) { return a; } return f; } void set() { } }\n")
    (tmp_path / ".quarry.json").write_text(json.dumps({"thresholds": {"WMC": {"max": 2}, "NOM": {"max": 5}}, "classRules": [{"name": "Busy", "conditions": [{"metric": "WMC", "min": 3}, {"metric": "NOM", "min": 2}]}, {"name": "Odd", "conditions": [{"metric": "NONE", "min": 1}]}], "methodRules": [{"name": "Branchy", "conditions": [{"metric": "CC", "min": 2}]}], "surplus": 1}))
    return tmp_path


def test_detect_and_validate(source, capsys):
    assert cli.main(["detect", str(source)]) == 0
    out = capsys.readouterr()
    report = json.loads(out.out)
    assert "surplus" in out.err
    assert report["classRules"][0] == {"name": "Busy", "matchCount": 1, "matches": [{"entity_id": "p.A", "path": f"file:{source}/A.java", "violations": [{"metric": "NOM", "value": 2.0, "min": 2.0}, {"metric": "WMC", "value": 3.0, "min": 3.0}], "severity": "low"}]}
    assert report["byClass"] == [{"entity_id": "p.A", "worst": "low", "rules": ["Busy"]}] and report["byMethod"][0]["entity_id"] == "p.A#get(int)"
    assert report["summary"]["classRules"] == {"total": 2, "matched": 1, "problems": [{"rule": "Odd", "code": "NONE", "problem": "unknown metric"}]} and report["summary"]["totalFindings"] == 2
    assert cli.main(["validate", str(source)]) == 1
    failed = json.loads(capsys.readouterr().out)
    assert [f["code"] for f in failed["failures"]] == ["WMC"]


def test_selected_metrics_to_a_file(source, capsys):
    assert cli.main(["analyze", str(source), "--metric", "weighted method count", "--metric", " wmc ", "--output", str(source / "report.json")]) == 0
    report = json.loads((source / "report.json").read_text())
    assert report["project"]["packages"] == []  # no package metric is selected, so there is no package to show
    with pytest.raises(SystemExit):
        cli.main(["analyze", str(source), "--metric", "nothing"])


def test_baselines_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([("f", "R", "a", "A", None, {"CC": 2.0}, 9, "p")], "fingerprint string, rule string, path string, name string, signature string, accepted map<string, double>, schema int, policy string")
    rows.write.json(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="schema"):
        reports.read_accepted(spark, str(tmp_path / "b"), "p")
