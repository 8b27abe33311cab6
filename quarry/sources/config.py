"""Policy inputs from files: thresholds, rules and exclusions (JSON or YAML), and profiles with overlays."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import literal_rows

THRESHOLD_SCHEMA = "code string, min double, max double"
CONDITION_SCHEMA = "rule string, code string, min double, max double"
#: The stock profiles, as code, least and largest value.
PROFILES = {
    "relaxed": """WMC 0..18; DIT 0..5; CBO 0..21; RFC 0..68; NOC 0..3; NOA 0..6; NOOM 0..5; NOM 0..11; Ce 0..11; Ca 0..12; LOC 0..17; CC 0..5; CND 0..3; LND 0..3; NOPM
0..5; FDP 0..5; NOAV 0..5; MND 0..5; CINT 0..11; CCM 0..12; ATFD 0..9; NOPA 0..5; NOAC 0..6; CCC 0..48; NCSS 0..1500; LCOM 0..77; NOAM 0..5; NOO
0..45; SIZE2 0..197; MPC 0..17; DAC 0..24; NOL 0..8; LAA 0.25..1; CDISP 0..0.62; TCC 0.25..1; WOC 0.38..1; I 0..1; A 0..1; D 0..0.62; MHF 0.07..0.53;
AHF 0.51..1; MIF 0.46..0.88; AIF 0.28..0.82; CF 0..0.43; PF 0.01..0.36""",
    "standard": """WMC 0..12; DIT 0..3; CBO 0..14; RFC 0..45; NOC 0..2; NOA 0..4; NOOM 0..3; NOM 0..7; Ce 0..7; Ca 0..8; LOC 0..11; CC 0..3; CND 0..2; LND 0..2; NOPM
0..3; FDP 0..3; NOAV 0..3; MND 0..3; CINT 0..7; CCM 0..8; ATFD 0..6; NOPA 0..3; NOAC 0..4; CCC 0..32; NCSS 0..1000; LCOM 0..51; NOAM 0..3; NOO 0..30;
SIZE2 0..131; MPC 0..11; DAC 0..16; NOL 0..5; LAA 0.33..1; CDISP 0..0.5; TCC 0.33..1; WOC 0.5..1; I 0..1; A 0..1; D 0..0.5; MHF 0.1..0.37; AHF
0.68..1; MIF 0.61..0.84; AIF 0.37..0.76; CF 0..0.24; PF 0.02..0.15""",
    "strict": """WMC 0..9; DIT 0..2; CBO 0..10; RFC 0..33; NOC 0..1; NOA 0..3; NOOM 0..2; NOM 0..5; Ce 0..5; Ca 0..6; LOC 0..8; CC 0..2; CND 0..1; LND 0..1; NOPM 0..2;
FDP 0..2; NOAV 0..2; MND 0..2; CINT 0..5; CCM 0..6; ATFD 0..4; NOPA 0..2; NOAC 0..3; CCC 0..24; NCSS 0..750; LCOM 0..38; NOAM 0..2; NOO 0..22; SIZE2
0..98; MPC 0..8; DAC 0..12; NOL 0..3; LAA 0.5..0.83; CDISP 0.12..0.38; TCC 0.5..0.83; WOC 0.62..0.88; I 0.25..0.75; A 0.25..0.75; D 0.12..0.38; MHF
0.16..0.3; AHF 0.76..0.92; MIF 0.67..0.79; AIF 0.47..0.66; CF 0.06..0.18; PF 0.05..0.12""",
}
PROJECT_KEYS = ("profile", "thresholds", "classRules", "classRulesFile", "methodRules", "methodRulesFile", "packageRules", "packageRulesFile", "exclusions", "validate", "detect", "analyze", "gate", "maintainability")
GATE_KEYS = ("growth", "failOn", "mode", "policy", "enforcement", "analysis", "sourceRoots", "classpath")
PROJECT_FILES = (".quarry.yml", ".quarry.yaml", ".quarry.json")
FAIL_TYPES = ("NEW_VIOLATION", "THRESHOLD_CROSSING", "GROWTH_BUDGET", "WORSENED")
MODES = ("worktree", "staged", "committed")


class ConfigError(ValueError):
    pass


def load(path: str):
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def _bound(code: str, name: str, value):
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ConfigError(f"{code}: {name} must be a finite number")
    return float(value)


def thresholds(spark: SparkSession, raw: dict, known: set[str]) -> DataFrame:
    """Threshold rows from {code: {min, max}}; strict: unknown metrics, missing and inverted bounds are errors."""
    rows = []
    for code, bounds in raw.items():
        if code not in known:
            raise ConfigError(f"unknown metric {code}")
        low, high = (_bound(code, n, bounds.get(n)) for n in ("min", "max"))
        if low is None and high is None:
            raise ConfigError(f"{code}: a bound is needed")
        if low is not None and high is not None and low > high:
            raise ConfigError(f"{code}: min is above max")
        rows.append((code, low, high))
    return literal_rows(spark, rows, THRESHOLD_SCHEMA)


def rules(spark: SparkSession, raw: list[dict]) -> DataFrame:
    """Condition rows from [{name, conditions: [{metric, min, max}]}]; problems are reported later, not raised."""
    rows = [(r["name"], c["metric"], None if c.get("min") is None else float(c["min"]), None if c.get("max") is None else float(c["max"])) for r in raw for c in r.get("conditions", [])]
    return literal_rows(spark, rows, CONDITION_SCHEMA)


def exclusions(raw) -> list[str]:
    """All strings of arbitrarily nested lists and maps, in order."""
    if isinstance(raw, str):
        return [raw]
    return [s for part in (raw.values() if isinstance(raw, dict) else raw or []) for s in exclusions(part)]


def profile_rows(name: str) -> list[tuple[str, float, float]]:
    """(code, min, max) of a stock profile."""
    if name not in PROFILES:
        raise ConfigError(f"unknown profile {name}")
    out = []
    for part in " ".join(PROFILES[name].split()).split("; "):
        code, bounds = part.split(" ")
        low, high = bounds.split("..")
        out.append((code, float(low), float(high)))
    return out


def profile(spark: SparkSession, name: str, overlay: DataFrame | None = None) -> DataFrame:
    """A stock profile; an overlay's rows replace those of the same code and add others."""
    base = literal_rows(spark, profile_rows(name), THRESHOLD_SCHEMA)
    if overlay is None:
        return base
    return base.join(overlay, "code", "left_anti").unionByName(overlay.select("code", F.col("min"), F.col("max")))


@dataclass
class Project:
    """A project's configuration file, read and checked."""

    file: str | None = None
    profile: str | None = None
    thresholds: dict | None = None
    rules: dict = field(default_factory=dict)  # level -> list of rules
    exclusions: list = field(default_factory=list)
    validate: dict = field(default_factory=dict)
    detect: dict = field(default_factory=dict)
    analyze: dict = field(default_factory=dict)
    gate: dict = field(default_factory=dict)
    policy: dict = field(default_factory=dict)
    unknown: list = field(default_factory=list)

    def growth(self) -> dict[str, float]:
        return {"CC": 5.0, "WMC": 20.0} | {c: float(v) for c, v in (self.gate.get("growth") or {}).items()}

    def fail_on(self) -> list[str]:
        return list(self.gate.get("failOn") or FAIL_TYPES[:3])

    def limits(self, spark: SparkSession, known: set[str], profile_name: str | None = None) -> DataFrame | None:
        """Thresholds in force: the profile given or named in the file, overlaid by the file's own; null if there is neither."""
        own = thresholds(spark, self.thresholds, known) if self.thresholds is not None else None
        name = profile_name or self.profile
        return profile(spark, name, own) if name else own


def discover(start: str) -> str | None:
    """The configuration file in ``start`` or the nearest folder above it."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name in PROJECT_FILES:
            if (folder / name).is_file():
                return str(folder / name)
    return None


def project(path: str | None) -> Project:
    """A configuration file; keys it doesn't know are reported in ``unknown``, wrong kinds of values are errors."""
    if path is None:
        return Project()
    raw = load(path)
    if raw is None:
        return Project(file=path)
    if not isinstance(raw, dict):
        raise ConfigError(f"{path}: a mapping is needed")
    sections = {k: raw.get(k) or {} for k in ("validate", "detect", "analyze", "gate", "maintainability")}
    for name, section in sections.items():
        if not isinstance(section, dict):
            raise ConfigError(f"{path}: {name} must be a mapping")
    gate = sections["gate"]
    for key in gate:
        if key not in GATE_KEYS:
            raise ConfigError(f"{path}: gate.{key} is no setting")
    for value in gate.get("failOn") or ():
        if value not in FAIL_TYPES:
            raise ConfigError(f"{path}: gate.failOn: {value} is no kind of finding")
    if gate.get("mode") not in (None, *MODES):
        raise ConfigError(f"{path}: gate.mode must be one of {', '.join(MODES)}")
    for code, budget in (gate.get("growth") or {}).items():
        if _bound(code, "growth", budget) is None or budget < 0:
            raise ConfigError(f"{path}: gate.growth.{code} must be a number of 0 or more")
    rules_ = {}
    for level in ("class", "method", "package"):
        inline, file = raw.get(f"{level}Rules"), raw.get(f"{level}RulesFile")
        if inline is not None and file is not None:
            raise ConfigError(f"{path}: {level}Rules and {level}RulesFile exclude each other")
        if file is not None:
            inline = load(str(Path(path).parent / file))
        if inline is not None:
            rules_[level] = inline
    return Project(path, raw.get("profile"), raw.get("thresholds"), rules_, exclusions(raw.get("exclusions")), sections["validate"], sections["detect"], sections["analyze"], gate, sections["maintainability"], sorted(set(raw) - set(PROJECT_KEYS)))
