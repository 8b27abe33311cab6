"""The catalogue of metrics as a dimension table: order, name, unit and what each needs to be measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import literal_rows

#: Codes in catalogue order, with their names.
METRICS = """
CND: Condition Nesting Depth; LND: Loop Nesting Depth; CC: Cyclomatic Complexity; NOL: Number of Loops; LOC: Lines of Code; NOPM: Number of
Parameters; LAA: Locality of Attribute Accesses; FDP: Foreign Data Providers; NOAV: Number of Accessed Variables; MND: Maximum Nesting Depth; CINT:
Coupling Intensity; CDISP: Coupling Dispersion; HVL: Halstead Volume; HD: Halstead Difficulty; HL: Halstead Length; HEF: Halstead Effort; HVC:
Halstead Vocabulary; HER: Halstead Errors; CCM: Cognitive Complexity; CLOC: Class Lines of Code; CCC: Class Cognitive Complexity; CHVL: Class Halstead
Volume; CHD: Class Halstead Difficulty; CHL: Class Halstead Length; CHEF: Class Halstead Effort; CHVC: Class Halstead Vocabulary; CHER: Class Halstead
Errors; WMC: Weighted Method Count; DIT: Depth of Inheritance Tree; CBO: Coupling Between Objects; RFC: Response for a Class; LCOM: Lack of Cohesion
of Methods; NOC: Number of Children; NOA: Number of Attributes; NOO: Number of Operations; NOOM: Number of Overridden Methods; NOAM: Number of Added
Methods; SIZE2: Attributes and Methods; NOM: Number of Methods; MPC: Message Passing Coupling; DAC: Data Abstraction Coupling; ATFD: Access To Foreign
Data; NOPA: Number of Public Attributes; NOAC: Number of Accessor Methods; WOC: Weight Of A Class; TCC: Tight Class Cohesion; NCSS: Non-Commenting
Source Statements; Ce: Efferent Coupling; Ca: Afferent Coupling; I: Instability; A: Abstractness; D: Normalized Distance from the Main Sequence;
PAHVL: Package Halstead Volume; PAHD: Package Halstead Difficulty; PACHL: Package Halstead Length; PACHEF: Package Halstead Effort; PACHVC: Package
Halstead Vocabulary; PACHER: Package Halstead Errors; PRHVL: Project Halstead Volume; PRHD: Project Halstead Difficulty; PRCHL: Project Halstead
Length; PRCHEF: Project Halstead Effort; PRCHVC: Project Halstead Vocabulary; PRCHER: Project Halstead Errors; MHF: Method Hiding Factor; AHF:
Attribute Hiding Factor; MIF: Method Inheritance Factor; AIF: Attribute Inheritance Factor; CF: Coupling Factor; PF: Polymorphism Factor; PNOCC:
Package Number of Concrete Classes; PNOAC: Package Number of Abstract Classes; PNOSC: Package Number of Static Classes; PNOI: Package Number of
Interfaces; PNCSS: Package Non-Commenting Source Statements; PLOC: Package Lines of Code; PNOKOBJ: Package Number of Kotlin Objects; PNOKCO: Package
Number of Kotlin Companion Objects; PNOKDC: Package Number of Kotlin Data Classes; PNOKSC: Package Number of Kotlin Sealed Classes; Reusability:
Reusability; Flexibility: Flexibility; Understandability: Understandability; Functionality: Functionality; Extendibility: Extendibility;
Effectiveness: Effectiveness; PRMI: Project Maintainability Index; PAMI: Package Maintainability Index; CMI: Class Maintainability Index; MMI: Method
Maintainability Index
"""
#: Metrics of one method's or class's own syntax, and those that need the whole project; all others need symbols.
SYNTAX_LOCAL = "CC CCM CND LND MND LOC NOPM NOL NOM WMC CCC CLOC".split()
PROJECT_GLOBAL = """Ca Ce I A D PAHVL PAHD PACHL PACHEF PACHVC PACHER PRHVL PRHD PRCHL PRCHEF PRCHVC PRCHER PRMI PAMI PNOKOBJ PNOKCO PNOKDC PNOKSC
PNOCC PNOAC PNOSC PNOI PNCSS PLOC Reusability Flexibility Understandability Functionality Extendibility Effectiveness
CBO DIT LCOM FDP NOC TCC ATFD DAC MPC LAA RFC SIZE2 NOOM NOAM MHF AHF MIF AIF CF PF""".split()
UNITS = {"complexity": "CC CCM", "nesting levels": "MND CND LND", "lines": "LOC CLOC NCSS", "declarations": "NOM NOO NOA NOPM", "ratio": "TCC WOC A I"}
SCOPES = ("SYNTAX_LOCAL", "SYMBOL_CONTEXT", "PROJECT_GLOBAL")
#: Derived metrics and what they are made from.
INPUTS = {
    "MMI": ("HVL", "CC", "LOC"), "CLOC": ("LOC",), "CCC": ("CCM",), "CMI": ("CHVL", "CC", "LOC"), "WMC": ("CC",), "PLOC": ("LOC",), "PNCSS": ("NCSS",),
    "PAHVL": ("CHVL",), "PAHD": ("CHD",), "PACHL": ("CHL",), "PACHEF": ("CHEF",), "PACHVC": ("CHVC",), "PACHER": ("CHER",), "PAMI": ("PAHVL", "CC", "LOC"),
    "PRHVL": ("PAHVL",), "PRHD": ("PAHD",), "PRCHL": ("PACHL",), "PRCHEF": ("PACHEF",), "PRCHVC": ("PACHVC",), "PRCHER": ("PACHER",), "PRMI": ("PRHVL", "CC", "LOC"),
    "I": ("Ce", "Ca"), "A": ("PNOAC", "PNOI", "PNOCC"), "D": ("I", "A"),
    "Reusability": ("Ce", "LCOM", "NOM", "PNOCC"), "Flexibility": ("Ce", "NOA", "NOOM"), "Understandability": ("A", "Ce", "LCOM", "NOOM", "WMC", "PNOCC"),
    "Functionality": ("LCOM", "NOOM", "NOM", "PNOCC", "DIT"), "Extendibility": ("A", "Ce", "NOM", "NOOM"), "Effectiveness": ("A", "NOA", "NOM", "NOOM"),
}


def codes() -> list[tuple[str, str]]:
    """(code, name) in catalogue order."""
    return [tuple(part.split(": ")) for part in " ".join(METRICS.split()).split("; ")]


def scope_of(code: str) -> str:
    return SCOPES[0] if code in SYNTAX_LOCAL else SCOPES[2] if code in PROJECT_GLOBAL else SCOPES[1]


def unit_of(code: str) -> str:
    return next((unit for unit, held in UNITS.items() if code in held.split()), "value")


def table(spark: SparkSession) -> DataFrame:
    """(code, name, ordinal, unit, scope)."""
    return literal_rows(spark, [(c, n, i, unit_of(c), scope_of(c)) for i, (c, n) in enumerate(codes())], "code string, name string, ordinal int, unit string, scope string")


def find(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``wanted`` (name) with the code that it names, as a code or by its full name, whatever its case and outer blanks; null for no metric."""
    keys = catalogue.select("code", F.explode(F.array_distinct(F.array(F.lower("code"), F.lower("name")))).alias("key"))
    return wanted.withColumn("key", F.lower(F.trim("name"))).join(keys, "key", "left").drop("key")


def available(requested: DataFrame, catalogue: DataFrame, scope: Column) -> DataFrame:
    """``requested`` (code) with available, and the reason why not: what a run of ``scope`` can't measure."""
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(SCOPES) for x in (s, i)))
    known = requested.join(catalogue.select("code", F.col("scope").alias("needs")), "code", "left")
    fits = rank[F.col("needs")] <= rank[scope]
    reason = F.when(F.col("needs").isNull(), "no such metric").when(~fits, F.concat(F.lit("needs "), F.translate(F.lower("needs"), "_", "-"), F.lit(" scope")))
    return known.select("code", F.col("needs").alias("scope"), F.coalesce(fits, F.lit(False)).alias("available"), reason.alias("reason"))


def closure(selected: set[str]) -> set[str]:
    """The selected metrics and everything that they are made from."""
    out, rest = set(), list(selected)
    while rest:
        if (code := rest.pop()) not in out:
            out.add(code)
            rest += INPUTS.get(code, ())
    return out


def in_order(metrics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Metric rows of the catalogue's codes with their ordinals."""
    return metrics.join(F.broadcast(catalogue.select("code", "ordinal")), "code")  # one row a code
