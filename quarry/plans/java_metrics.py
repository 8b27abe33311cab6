"""Metrics of Java sources as long rows (level, entity_id, parent_id, code, value, is_integral, state).

Everything is a DataFrame expression over the tables of ``quarry.sources.java_source``; what needs names resolved
by scope and imports comes from ``java_symbols``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import formulas
from quarry.functions.value import truncated_ratio
from quarry.operators import graph, mood, rollup
from quarry.operators.rollup import long_form
from quarry.operators.tokens import halstead_counts
from quarry.plans import java_names, java_symbols
from quarry.sources import java_source

METHOD = ["path", "package", "class", "member"]
#: Codes of package sums; those of the project begin with PR instead of PA.
SUMMED = {"CHVL": "PAHVL", "CHD": "PAHD", "CHL": "PACHL", "CHEF": "PACHEF", "CHVC": "PACHVC", "CHER": "PACHER"}
HALSTEAD = {"volume": "HVL", "difficulty": "HD", "length": "HL", "effort": "HEF", "vocabulary": "HVC", "errors": "HER"}


@dataclass
class Analysis:
    tables: dict[str, DataFrame]
    metrics: DataFrame
    symbols: java_symbols.Symbols

    def level(self, name: str) -> DataFrame:
        return self.metrics.filter(F.col("level") == name)

    def entities(self) -> DataFrame:
        """(level, entity_id, path, name, signature, line, end_line, params) of classes and methods; a class has no signature."""
        none = F.lit(None).cast("string")
        classes_ = self.tables["classes"].select(F.lit("class").alias("level"), F.col("class").alias("entity_id"), "path", F.col("class").alias("name"), none.alias("signature"), "line", "end_line", F.lit(None).cast("long").alias("params"))
        found = self.tables["members"].filter("member_kind != 'field'")
        return classes_.unionByName(found.select(F.lit("method").alias("level"), F.concat_ws("#", "class", "member").alias("entity_id"), "path", F.col("class").alias("name"), F.col("member").alias("signature"), "line", "end_line", "params"))

    def measures(self) -> DataFrame:
        """(path, name, signature, code, value) of classes and methods."""
        return self.metrics.join(self.entities().select("level", "entity_id", "path", "name", "signature"), ["level", "entity_id"]).select("path", "name", "signature", "code", "value")


def _has(column: str, word: str) -> Column:
    return F.array_contains(column, word)


def methods(t: dict[str, DataFrame]) -> DataFrame:
    """One row a method or constructor with the syntax-local metrics."""
    kind, op = F.col("kind"), F.col("op")
    loops = kind.isin(*java_source.LOOPS)
    decision = kind.isin("if", "entry", "catch", "ternary") | loops | ((kind == "binary") & op.isin("&&", "||"))
    cognitive = F.when(kind.isin(*(java_source.COGNITIVE - {"lambda"})), 1 + F.col("d_cog")).when(kind == "logical-run", 1).when(kind.isin("break", "continue") & F.col("name").isNotNull(), 1).otherwise(0)
    deepest = lambda kinds, d: F.coalesce(F.max(F.when(kind.isin(*kinds), F.col(d))), F.lit(0))
    nested = t["nodes"].filter("member_kind in ('method', 'constructor')").groupBy(*METHOD).agg(
        F.count_if(decision).alias("decisions"), F.sum(cognitive).alias("CCM"), F.count_if(loops).alias("NOL"), deepest(java_source.CONDITIONS, "d_cond").alias("CND"),
        deepest(java_source.LOOPS, "d_loop").alias("LND"), deepest(java_source.CONDITIONS | java_source.LOOPS, "d_nest").alias("MND"),
    )
    lines = F.coalesce(F.col("body_end") - F.col("body_line"), F.col("end_line") - F.col("line")) + 1
    base = t["members"].filter("member_kind != 'field'").select(*METHOD, "member_kind", "name", "modifiers", "annotations", "type", "class_kind", lines.alias("LOC"), F.col("params").alias("NOPM"))
    joined = base.join(nested, METHOD, "left").na.fill(0, ["decisions", "CCM", "NOL", "CND", "LND", "MND"]).withColumn("CC", 1 + F.col("decisions"))
    measured = _halstead(t["tokens"].filter("member is not null"), METHOD, "")
    out = joined.join(measured, METHOD, "left")
    return out.withColumn("MMI", formulas.maintainability(F.col("HVL"), F.col("CC").cast("double"), F.col("LOC").cast("double")))


def _halstead(tokens: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    counts = halstead_counts(tokens.select(F.struct(*keys).alias("key"), F.col("name").alias("token"), (F.col("kind") == "operator").alias("is_operator")), "key")
    measures = formulas.halstead(*(F.col(c) for c in ("n1", "n2", "big_n1", "big_n2")))
    return counts.select("key.*", *(measures[m].alias(prefix + c) for m, c in HALSTEAD.items()))


def classes(t: dict[str, DataFrame], method_rows: DataFrame) -> DataFrame:
    keys = ["path", "package", "class"]
    is_method = F.col("member_kind") == "method"
    override = _has("annotations", "Override")
    getter = F.col("name").rlike("^get") & (F.col("NOPM") == 0) & (F.col("type") != "void")
    setter = F.col("name").rlike("^set") & (F.col("NOPM") == 1) & (F.col("type") == "void")
    interface = F.col("class_kind") == "interface"
    sums = method_rows.groupBy(*keys).agg(
        F.sum("CC").alias("WMC"), F.count("*").alias("NOM"), F.count_if(is_method).alias("NOO"), F.count_if(is_method & override & ~interface).alias("NOOM"), F.count_if(is_method & ~override & ~interface).alias("NOAM"),
        F.count_if(is_method & (getter | setter)).alias("NOAC"), F.sum(F.when(is_method, F.col("LOC"))).alias("CLOC"), F.sum(F.when(is_method, F.col("CCM"))).alias("CCC"), F.sum(F.when(is_method, F.col("CC"))).alias("method_cc"),
    )
    fields = t["members"].filter("member_kind = 'field'").groupBy(*keys).agg(F.count_if(_has("modifiers", "public")).alias("NOPA"), F.sum("params").alias("own_fields"))
    statements = t["nodes"].filter("kind = 'statement'").groupBy(*keys).agg(F.sum("params").alias("statements"))
    counts = ["WMC", "NOM", "NOO", "NOOM", "NOAM", "NOAC", "CLOC", "CCC", "NOPA", "own_fields"]
    out = t["classes"].select(*keys, "class_kind", "name", "modifiers", "supers", "interfaces", "line", "end_line")
    out = out.join(sums, keys, "left").join(fields, keys, "left").join(statements, keys, "left").na.fill(0, [*counts, "statements", "method_cc"]).withColumn("NCSS", F.col("statements") + 1)
    out = out.join(_halstead(t["tokens"].filter("member is null"), keys, "C"), keys, "left").join(_cohesion(t), keys, "left").na.fill(0.0, ["TCC"])
    return out.withColumn("CMI", formulas.class_maintainability(F.col("CHVL"), F.col("method_cc").cast("double"), F.col("CLOC").cast("double")))


def _cohesion(t: dict[str, DataFrame]) -> DataFrame:
    """TCC: share of method pairs that use a field of the class in common, by name."""
    keys = ["path", "class"]
    used = t["nodes"].filter("member_kind = 'method' and kind in ('name', 'own-field-access')").select(*keys, "package", "member", "name").distinct()
    fields = java_names.own_fields(t).filter("not is_static").select(*keys, "name").distinct()
    usable = t["members"].filter((F.col("member_kind") == "method") & ~_has("modifiers", "static") & ~_has("modifiers", "abstract") & ~F.col("name").isin(*java_symbols.BOILERPLATE)).select(*keys, "package", "member")
    touching = used.join(fields, [*keys, "name"]).join(usable, [*keys, "package", "member"], "left_semi")
    a, b = (touching.select(*keys, "package", "name", F.col("member").alias(s)) for s in "ab")
    pairs = a.join(b, [*keys, "package", "name"]).filter("a < b").select(*keys, "package", "a", "b").distinct().groupBy(*keys, "package").agg(F.count("*").alias("pairs"))
    n = usable.groupBy(*keys, "package").agg(F.count("*").alias("n"))
    ratio = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("pairs", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2))
    return n.join(pairs, [*keys, "package"], "left").select(*keys, "package", ratio.alias("TCC"))


def packages(class_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a package; ``edges`` (src, dst) are its dependencies, on packages outside the project too."""
    interface, abstract = F.col("class_kind") == "interface", _has("modifiers", "abstract") & (F.col("class_kind") == "class")
    out = class_rows.groupBy("package").agg(
        F.count_if(~interface & ~abstract).alias("PNOCC"), F.count_if(abstract).alias("PNOAC"), F.count_if(interface).alias("PNOI"), F.count_if(_has("modifiers", "static")).alias("PNOSC"),
        F.count("*").alias("n"), F.sum("NCSS").alias("PNCSS"), F.sum("CLOC").alias("PLOC"), F.sum("method_cc").alias("cc"), *(F.sum(c).alias(p) for c, p in SUMMED.items()),
    )
    edges = graph.kept(edges)
    own = out.select("package")
    ce = edges.groupBy(F.col("src").alias("package")).agg(F.count("*").alias("Ce"))
    ca = edges.join(own.withColumnRenamed("package", "src"), "src", "left_semi").groupBy(F.col("dst").alias("package")).agg(F.count("*").alias("Ca"))
    out = out.join(ce, "package", "left").join(ca, "package", "left").na.fill(0, ["Ce", "Ca"])
    out = out.withColumn("I", F.coalesce(F.try_divide(F.col("Ce").cast("double"), F.col("Ce") + F.col("Ca")), F.lit(0.0))).withColumn("A", (F.col("PNOAC") + F.col("PNOI")) / F.col("n").cast("double"))
    out = out.withColumn("D", F.abs(1 - F.col("I") - F.col("A")))
    return out.withColumn("PAMI", formulas.maintainability(F.col("PAHVL"), F.col("cc").cast("double"), F.col("PLOC").cast("double")))


#: Counts of Kotlin declarations, of which Java sources have none.
KOTLIN = ["PNOKOBJ", "PNOKCO", "PNOKDC", "PNOKSC"]
QUALITIES = {"reusability": "Reusability", "flexibility": "Flexibility", "understandability": "Understandability", "functionality": "Functionality", "extendibility": "Extendibility", "effectiveness": "Effectiveness"}
METHOD_CODES = ["CC", "CCM", "CND", "LND", "MND", "NOL", "LOC", "NOPM", "NOAV", "CINT", "CDISP", *HALSTEAD.values(), "MMI"]
CLASS_CODES = ["WMC", "NOM", "NOO", "NOOM", "NOAM", "NOAC", "NOPA", "NCSS", "TCC", "CLOC", "CCC", *(f"C{c}" for c in HALSTEAD.values()), "CMI", "DIT", "NOC", "NOA", "SIZE2", "DAC", "CBO", "RFC", "MPC", "WOC", "LCOM", "ATFD", "LAA", "FDP"]
PACKAGE_CODES = ["Ce", "Ca", "I", "A", "D", "PNOCC", "PNOAC", "PNOI", "PNOSC", *KOTLIN, "PNCSS", "PLOC", *SUMMED.values(), "PAMI"]
PROJECT_CODES = ["PNOCC", "PNOAC", "PNOI", "PNOSC", *KOTLIN, "PNCSS", "PLOC", *(f"PR{p[2:]}" for p in SUMMED.values()), "PRMI", "MHF", "AHF", "MIF", "AIF", "CF", "PF", *QUALITIES.values()]


def design_factors(symbols: java_symbols.Symbols) -> DataFrame:
    """One row: MHF, AHF, MIF, AIF, CF and PF."""
    classes, methods_, fields = map(graph.kept, symbols.declared())
    lines = symbols.lines.select(F.col("src").alias("class"), F.col("dst").alias("ancestor")).join(classes.select(F.col("class").alias("ancestor")), "ancestor", "left_semi")
    lines = graph.kept(lines.select("class", "ancestor"))
    parts = {
        "MHF": mood.hiding(methods_, classes, lines), "AHF": mood.hiding(fields, classes, lines), "MIF": mood.method_inheritance(methods_, classes, lines),
        "AIF": mood.field_inheritance(fields, classes, lines), "CF": mood.coupling_factor(symbols.foreign_couplings(), classes), "PF": mood.polymorphism(methods_, classes, lines),
    }
    row = None
    for code, part in parts.items():
        one = part.select(F.col("factor").alias(code))
        row = one if row is None else row.crossJoin(F.broadcast(one))  # one row each
    return row


def qualities(class_rows: DataFrame, package_rows: DataFrame) -> DataFrame:
    """One row with the six design attributes."""
    by_class = rollup.z_scores(class_rows, {"lcom": (F.col("LCOM"), True), "messaging": (F.col("NOM"), True), "composition": (F.col("NOA"), True), "polymorphism": (F.col("NOOM"), True), "complexity": (F.col("WMC"), True), "hierarchies": (F.col("DIT"), True)})
    by_package = rollup.z_scores(package_rows, {"coupling": (F.col("Ce"), True), "size": (F.col("PNOCC"), True), "abstraction": (F.col("A"), False)})
    whole = truncated_ratio(F.col("NOOM"), F.col("NOM") * 100)
    inherited = class_rows.agg(F.coalesce(F.sum(F.when(F.col("NOM") > 0, whole)), F.lit(0)).cast("double").alias("inheritance"))
    row = by_class.crossJoin(F.broadcast(by_package)).crossJoin(F.broadcast(inherited))  # one row each
    cohesion = F.when(F.col("lcom") == 0, 0.0).otherwise(1 / F.col("lcom"))
    z = {n: F.col(n) for n in ("messaging", "composition", "polymorphism", "complexity", "hierarchies", "coupling", "size", "abstraction", "inheritance")} | {"cohesion": cohesion, "encapsulation": F.lit(1.0)}
    return row.select(*(v.alias(QUALITIES[n]) for n, v in formulas.design_quality(z).items()))


_EXTRA: list[tuple[str, str, Callable[[dict[str, DataFrame]], DataFrame]]] = []


def register_metric(code: str, level: str, build: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    """Adds a metric: ``build`` maps the syntax tables to (entity_id, parent_id, value)."""
    if level not in ("method", "class", "package", "project") or any(c == code for c, _, _ in _EXTRA) or code in {*METHOD_CODES, *CLASS_CODES, *PACKAGE_CODES, *PROJECT_CODES}:
        raise ValueError(f"{code}: the level is unknown or the code is taken")
    _EXTRA.append((code, level, build))


def analyze(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = ()) -> Analysis:
    """All metrics of the sources below ``roots``. Undefined values are rows without a value; unmeasured token metrics are none.

    Roots that can't be read are diagnostics.
    """
    _, problems = java_source.root_problems(roots)
    return measure(spark, java_source.files(spark, roots, exclude), problems)


def measure(spark: SparkSession, sources: DataFrame, problems: list[tuple[str, str, str]] = ()) -> Analysis:
    """``analyze`` of source rows (path, content)."""
    t = java_source.tables(sources)
    if problems:
        t["diagnostics"] = t["diagnostics"].unionByName(spark.createDataFrame(problems, "path string, kind string, name string"), allowMissingColumns=True)
    symbols = java_symbols.Symbols(t)
    zeros = [F.lit(0).cast("long").alias(c) for c in KOTLIN]
    method_rows = methods(t).join(symbols.variables_and_callees(), METHOD, "left").join(symbols.method_metrics(), METHOD, "left").withColumn("CDISP", F.when(F.col("member_kind") == "method", F.coalesce("CDISP", F.lit(0))))
    method_rows = graph.kept(method_rows.withColumn("entity", F.concat_ws("#", "class", "member")))
    class_rows = classes(t, method_rows)
    class_rows = class_rows.join(symbols.inheritance(), "class", "left").join(java_names.class_metrics(t, symbols.superclasses()), ["path", "package", "class"], "left").join(symbols.class_metrics(), "class", "left").join(symbols.coupling_metrics(), "class", "left")
    class_rows = graph.kept(class_rows)
    package_rows = graph.kept(packages(class_rows, symbols.package_edges()).select("*", *zeros))
    project = package_rows.agg(*(F.sum(c).alias(c) for c in ("PNOCC", "PNOAC", "PNOI", "PNOSC", "PNCSS", "PLOC")), F.sum("cc").alias("cc"), *(F.coalesce(F.sum(p), F.lit(0.0)).alias(f"PR{p[2:]}") for p in SUMMED.values()))
    project = project.withColumn("PRMI", formulas.project_maintainability(F.col("PRHVL"), F.col("cc"), F.col("PLOC"))).select("*", *zeros, F.lit("project").alias("entity"), F.lit(None).cast("string").alias("parent"))
    project = graph.kept(project.crossJoin(F.broadcast(design_factors(symbols))).crossJoin(F.broadcast(qualities(class_rows, package_rows))))  # one row each
    rows = long_form(method_rows, "method", "entity", "class", METHOD_CODES).unionByName(long_form(class_rows, "class", "class", "package", CLASS_CODES))
    rows = rows.unionByName(long_form(package_rows.withColumn("parent", F.lit("project")), "package", "package", "parent", PACKAGE_CODES)).unionByName(long_form(project, "project", "entity", "parent", PROJECT_CODES))
    for code, level, build in _EXTRA:
        rows = rows.unionByName(long_form(build(t).withColumnRenamed("value", code), level, "entity_id", "parent_id", [code]))
    undefined = F.col("code").isin("MMI", "CMI", "PAMI", "RFC", "LAA", "FDP")
    return Analysis(t, rows.filter(F.col("value").isNotNull() | undefined), symbols)
