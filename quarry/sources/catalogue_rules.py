"""The versioned rule catalogue and policy overlays."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.scope import ROLES
from quarry.session import literal_rows

#: Id, title, level, maturity, required scope, worsening kind, budgets, and conditions (code, min, max); all of version 1, mode warn.
CATALOGUE = [
    ("MT-M001", "High method complexity", "method", "candidate", "SYNTAX_LOCAL", "RISES_BY", {"CC": 5.0}, [("CC", 16.0, None)]),
    ("MT-M002", "Deep nesting", "method", "candidate", "SYNTAX_LOCAL", "RISES_BY", {"MND": 2.0}, [("MND", 5.0, None)]),
    ("MT-M003", "Large method with branching", "method", "candidate", "SYNTAX_LOCAL", "RISES_BY_WHILE_OTHERS_HOLD", {"LOC": 20.0}, [("LOC", 61.0, None), ("CC", 11.0, None)]),
    ("MT-C001", "Concentrated class complexity with foreign data access", "class", "experimental", "PROJECT_GLOBAL", "RISES_BY_WHILE_OTHERS_HOLD", {"WMC": 20.0}, [("WMC", 47.0, None), ("ATFD", 6.0, None), ("TCC", None, 0.33)]),
    ("MT-C002", "Large class complexity and method count", "class", "candidate", "SYNTAX_LOCAL", "RISES_BY_WHILE_OTHERS_HOLD", {"WMC": 20.0}, [("WMC", 80.0, None), ("NOM", 15.0, None)]),
]
VERSION, SEVERITY = 1, "warning"
ENABLED = ("MT-M001", "MT-M002", "MT-M003", "MT-C002")
MODES = ("off", "warn", "error")


class PolicyError(ValueError):
    pass


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, VERSION, title, level, maturity, scope, worsening, i in ENABLED, "warn", SEVERITY) for i, title, level, maturity, scope, worsening, _, _ in CATALOGUE]
    return literal_rows(spark, rows, "rule string, version int, title string, level string, maturity string, scope string, worsening string, enabled boolean, mode string, severity string")


def conditions(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, [(i, *c) for i, *_, cs in CATALOGUE for c in cs], "rule string, code string, min double, max double")


def effective(rule_rows: DataFrame, condition_rows: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and conditions after overrides (rule, code, mode, min, max); what an override leaves null stays."""
    modes = overrides.filter("mode is not null").groupBy("rule").agg(F.max("mode").alias("new_mode"))
    rules_ = rule_rows.join(modes, "rule", "left").withColumn("mode", F.coalesce("new_mode", "mode")).drop("new_mode")
    bounds = overrides.filter("code is not null").select("rule", "code", F.col("min").alias("new_min"), F.col("max").alias("new_max"))
    conditions_ = condition_rows.join(bounds, ["rule", "code"], "left").select("rule", "code", F.coalesce("new_min", "min").alias("min"), F.coalesce("new_max", "max").alias("max"))
    return rules_, conditions_


def check(overrides: list[dict], suppressions: list[dict]) -> None:
    """Refuses overrides and suppressions of unknown rules, repeated overrides, and blocking experimental rules."""
    known = {i for i, *_ in CATALOGUE}
    seen = set()
    for o in overrides:
        if o["rule"] not in known:
            raise PolicyError(f"unknown rule {o['rule']}")
        if (key := (o["rule"], o.get("code"))) in seen:
            raise PolicyError(f"{key} is overridden twice")
        seen.add(key)
        if o.get("mode") in ("block", "error") and next(r[3] for r in CATALOGUE if r[0] == o["rule"]) == "experimental":
            raise PolicyError(f"{o['rule']} is experimental and can't block")
    for s in suppressions:
        if s["rule"] not in known:
            raise PolicyError(f"unknown rule {s['rule']}")


@dataclass
class Policy:
    """Which rules of the catalogue are in force, and how."""

    enabled: tuple[str, ...] = ENABLED
    overrides: dict[str, dict] = field(default_factory=dict)  # rule -> mode, severity, roles, limits
    roles: list[tuple[str, str]] = field(default_factory=lambda: list(ROLES))  # (role, pattern), the first that matches
    suppressions: list[dict] = field(default_factory=list)  # rule, path, name, signature, reason, expires

    def rules(self) -> list[dict]:
        """The rules in force with their overrides."""
        out = []
        for i, title, level, maturity, scope, worsening, budgets, conditions_ in CATALOGUE:
            over = self.overrides.get(i, {})
            mode = over.get("mode", "warn")
            if i in self.enabled and mode != "off":
                limits = over.get("limits", {})
                bounds = [(c, limits.get(c, {}).get("min", low), limits.get(c, {}).get("max", high)) for c, low, high in conditions_]
                out.append({"rule": i, "version": VERSION, "title": title, "level": level, "maturity": maturity, "scope": scope, "worsening": worsening, "budgets": budgets, "conditions": bounds, "mode": mode, "severity": over.get("severity", SEVERITY), "roles": over.get("roles")})
        return out

    def digest(self) -> str:
        """SHA-256 of all that decides: the rules in force, roles in their order, suppressions sorted."""
        suppressions = sorted([s["rule"], s["path"], s["name"], s.get("signature") or "", s.get("expires") or ""] for s in self.suppressions)
        text = json.dumps({"rules": self.rules(), "roles": self.roles, "suppressions": suppressions}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()


def _keys(where: str, given: dict, known: tuple[str, ...]) -> None:
    for key in given:
        if key not in known:
            raise PolicyError(f"{where}.{key} is no setting")


def policy(raw: dict) -> Policy:
    """A policy from the ``maintainability`` section of a configuration file; anything it doesn't know is an error."""
    _keys("maintainability", raw, ("enabledRules", "rules", "roles", "suppressions"))
    known = {r[0]: r for r in CATALOGUE}
    enabled = tuple(raw.get("enabledRules", ENABLED))
    for rule in (*enabled, *(raw.get("rules") or {})):
        if rule not in known:
            raise PolicyError(f"unknown rule {rule}")
    overrides = {}
    for rule, over in (raw.get("rules") or {}).items():
        _keys(f"rules.{rule}", over, ("mode", "severity", "roles", "limits"))
        if over.get("mode", "warn") not in MODES:
            raise PolicyError(f"rules.{rule}.mode must be one of {', '.join(MODES)}")
        for code, bounds in (over.get("limits") or {}).items():
            if code not in {c[0] for c in known[rule][7]}:
                raise PolicyError(f"rules.{rule}.limits.{code} is no condition of the rule")
            _keys(f"rules.{rule}.limits.{code}", bounds, ("min", "max"))
        overrides[rule] = dict(over)
    roles = [(r["role"], r["pathRegex"]) for r in raw.get("roles") or ()]
    for _, pattern in roles:
        re.compile(pattern)
    suppressions = []
    for s in raw.get("suppressions") or ():
        _keys("suppressions", s, ("ruleId", "entity", "reason", "expiresOn"))
        if not s.get("reason"):
            raise PolicyError("a suppression needs a reason")
        _keys("suppressions.entity", s["entity"], ("path", "class", "signature"))
        if s.get("expiresOn") is not None:
            datetime.date.fromisoformat(str(s["expiresOn"]))
        suppressions.append({"rule": s["ruleId"], "path": s["entity"]["path"], "name": s["entity"]["class"], "signature": s["entity"].get("signature"), "reason": s["reason"], "expires": str(s["expiresOn"]) if s.get("expiresOn") else None})
    check([{"rule": rule, "mode": over.get("mode")} for rule, over in overrides.items()], suppressions)
    return Policy(enabled, overrides, roles + list(ROLES), suppressions)
