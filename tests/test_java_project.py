"""A small project with every value worked out by hand."""

import math

import pytest

from quarry.plans import java_metrics

SOURCES = {
    "p/Account.java": """package p;
public class Account {
    protected long balance;
    private String owner;
    public static int count;
    public Account(String owner) { this.owner = owner; }
    public long getBalance() { return balance; }
    protected void add(long n) { balance += n; }
    void audit() { }
}
""",
    "p/Savings.java": """package p;
public class Savings extends Account {
    private double rate;
    public Savings() { super("x"); }
    @Override protected void add(long n) { super.add(n); rate = rate + 1; }
}
""",
    "q/Report.java": """package q;
import p.Account;
public class Report {
    Account account;
    public long total(Account other) { return account.getBalance() + other.getBalance() + Math.abs(1); }
    static int many() { return Account.count; }
}
""",
    # another class of the same simple name must not be taken for p.Account
    "r/Account.java": "package r;\npublic interface Account { }\n",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in SOURCES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = java_metrics.analyze(spark, [str(root), str(root / "p"), str(root / "nowhere")])
    assert [(r.kind, r.path) for r in rows.tables["diagnostics"].collect()] == [("ROOT_MISSING", str(root / "nowhere"))]
    return {(r.entity_id, r.code): r.value for r in rows.metrics.collect()}


def test_classes(found):
    expected = {
        "p.Account": {"ATFD": 0, "LAA": 1, "FDP": 1, "DIT": 1, "NOC": 1, "CBO": 1, "MPC": 0, "RFC": 4, "DAC": 1, "SIZE2": 2 + 3 + 11, "NOA": 3, "WOC": 0},
        "p.Savings": {"ATFD": 0, "LAA": 1, "FDP": 0, "DIT": 2, "NOC": 0, "CBO": 2, "MPC": 1, "RFC": 4, "DAC": 0, "SIZE2": 1 + 2 + 3 + 11, "NOA": 4, "WOC": 1},
        "q.Report": {"ATFD": 1, "LAA": 0.5, "FDP": 0, "DIT": 1, "NOC": 0, "CBO": 2, "MPC": 3, "RFC": 4, "DAC": 1, "SIZE2": 1 + 1 + 11, "NOA": 1, "WOC": 1},
    }
    for name, codes in expected.items():
        assert {c: found[name, c] for c in codes} == pytest.approx(codes), name


def test_methods(found):
    assert (found["q.Report#total(Account)", "CDISP"], found["q.Report#total(Account)", "CINT"], found["q.Report#total(Account)", "NOAV"]) == (1, 2, 2)
    assert (found["p.Savings#add(long)", "CDISP"], found["p.Savings#add(long)", "NOAV"]) == (1, 2)


def test_packages(found):
    assert {(p, c): found[p, c] for p in ("p", "q", "r") for c in ("Ce", "Ca", "PNOKOBJ", "PNOI")} == {
        ("p", "Ce"): 1, ("p", "Ca"): 1, ("p", "PNOKOBJ"): 0, ("p", "PNOI"): 0, ("q", "Ce"): 2, ("q", "Ca"): 0, ("q", "PNOKOBJ"): 0, ("q", "PNOI"): 0,
        ("r", "Ce"): 0, ("r", "Ca"): 0, ("r", "PNOKOBJ"): 0, ("r", "PNOI"): 1,
    }


def test_design_factors(found):
    value = lambda c: found["project", c]
    # four classes: two public methods are seen by 3, two protected and audit by 1, many by none; the fields likewise
    assert value("MHF") == pytest.approx((6 * 3 - (2 * 3 + 3)) / (6 * 3)) and value("AHF") == pytest.approx((5 * 3 - (3 + 1)) / (5 * 3))
    # Savings inherits getBalance and audit, balance and count; it overrides one of three methods that could be
    assert value("MIF") == pytest.approx(2 / 8) and value("AIF") == pytest.approx(2 / 7) and value("PF") == pytest.approx(1 / 3)
    # String; Account and Math
    assert value("CF") == pytest.approx(3 / 6)


def test_design_attributes(found):
    classes, packages = ("p.Account", "p.Savings", "q.Report", "r.Account"), ("p", "q", "r")

    def z(names, code):
        values = [found[n, code] for n in names]
        average = sum(values) / len(values) if code == "A" else int(sum(values)) // len(values)
        spread = math.sqrt(sum((v - average) ** 2 for v in values) / len(values))
        return (max(values) - average) / spread if spread else 0.0

    lcom = z(classes, "LCOM")
    cohesion, messaging, coupling, size = 1 / lcom if lcom else 0.0, z(classes, "NOM"), z(packages, "Ce"), z(packages, "PNOCC")
    assert found["project", "Reusability"] == pytest.approx(-0.25 * coupling + 0.25 * cohesion + 0.5 * messaging + 0.5 * size)
    assert found["project", "Flexibility"] == pytest.approx(0.25 - 0.25 * coupling + 0.5 * z(classes, "NOA") + 0.5 * z(classes, "NOOM"))
    assert found["project", "Extendibility"] == pytest.approx(0.5 * z(packages, "A") - 0.5 * coupling + 0.5 * z(classes, "NOOM"))
