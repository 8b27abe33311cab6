"""Class and method metrics of Java that need names resolved.

Fields are looked up along the chain of superclasses, used types by the last part of their names. Where the definition needs the type of an arbitrary expression, nothing is measured rather than
guessed; ``coverage`` says which share of names was resolved.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.plans import java_symbols

CLASS = ["path", "package", "class"]
METHOD = [*CLASS, "member"]
def own_fields(t: dict[str, DataFrame]) -> DataFrame:
    """(class keys, name, type, is_static) of the declared fields, one row a variable."""
    fields = t["members"].filter("member_kind = 'field'").select(*METHOD, F.array_contains("modifiers", "static").alias("is_static"))
    variables = t["nodes"].filter("member_kind = 'field' and kind = 'variable'").select(*METHOD, "name", "type").distinct()
    return variables.join(fields, METHOD).drop("member").distinct()


def class_metrics(t: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
    """Per class: NOA (own and inherited fields within the project) and LCOM; ``lines`` (class, ancestor) along superclasses."""
    fields = graph.kept(own_fields(t))
    methods = t["members"].filter("member_kind = 'method'")
    nodes = t["nodes"].filter("kind != 'statement'")
    inherited = lines.join(fields.select(F.col("class").alias("ancestor"), "name"), "ancestor").groupBy("class").agg(F.count("*").alias("more_fields"))
    own = fields.groupBy(*CLASS).agg(F.count("*").alias("fields"))
    out = t["classes"].select(*CLASS).join(own, CLASS, "left").join(_cohesion(t, fields, methods, nodes), CLASS, "left").join(inherited, "class", "left").na.fill(0, ["fields", "more_fields", "LCOM"])
    return out.select(*CLASS, (F.col("fields") + F.col("more_fields")).alias("NOA"), "LCOM")


def _cohesion(t, fields, methods, nodes) -> DataFrame:
    """LCOM: components of the instance methods that use a field of the class; edges are fields and calls in common."""
    usable = methods.filter(~F.array_contains("modifiers", "static") & ~F.col("name").isin(*java_symbols.BOILERPLATE)).select(*METHOD, "name", "params")
    touched = nodes.filter("kind in ('name', 'own-field-access')").select(*METHOD, "name").distinct().join(fields.filter("not is_static").select(*CLASS, "name"), [*CLASS, "name"])
    touched = touched.join(usable.select(*METHOD), METHOD, "left_semi").distinct()
    users = touched.select(*METHOD).distinct()
    stars = touched.join(touched.groupBy(*CLASS, "name").agg(F.min("member").alias("b")), [*CLASS, "name"]).filter("member != b").select(*CLASS, F.col("member").alias("a"), "b")
    arity = F.when(F.col("op") == ".", F.col("params") - 1).otherwise(F.col("params"))
    calls = nodes.filter("kind = 'call'").select(*CLASS, F.col("member").alias("a"), "name", arity.alias("params"))
    callees = usable.join(users, METHOD, "left_semi").select(*CLASS, "name", "params", F.col("member").alias("b"))
    called = calls.join(callees, [*CLASS, "name", "params"]).filter("a != b").select(*CLASS, "a", "b").join(users.withColumnRenamed("member", "a"), [*CLASS, "a"], "left_semi")
    edges = stars.unionByName(called).select(*CLASS, "a", "b").unionByName(users.select(*CLASS, F.col("member").alias("a"), F.col("member").alias("b")))
    return edges.groupBy(*CLASS).applyInArrow(_components, "path string, package string, class string, LCOM long")


def _components(edges: pa.Table) -> pa.Table:
    """One row: how many components the edges (a, b) of one class have; a node without others is an edge to itself."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
        root[find(a)] = find(b)
    one = edges.slice(0, 1)
    return pa.Table.from_arrays([*(one.column(c) for c in CLASS), pa.array([sum(find(x) == x for x in list(root))], pa.int64())], names=[*CLASS, "LCOM"])


def coverage(t: dict[str, DataFrame]) -> DataFrame:
    """attempts, resolved and coverage of plain names in methods; coverage is null without any."""
    nodes = t["nodes"].filter("kind = 'name' and member_kind in ('method', 'constructor')").select(*METHOD, "name").distinct()
    local = t["nodes"].filter("kind in ('parameter', 'variable', 'lambda-parameter')").select(*METHOD, "name").distinct()
    fields = own_fields(t).select("class", "name").distinct()
    types = t["classes"].select("name").distinct()
    unknown = nodes.join(local, [*METHOD, "name"], "left_anti").join(fields, ["class", "name"], "left_anti").join(types, "name", "left_anti")
    counts = nodes.agg(F.count("*").alias("attempts")).crossJoin(F.broadcast(unknown.agg(F.count("*").alias("unknown"))))
    return counts.select("attempts", (F.col("attempts") - F.col("unknown")).alias("resolved"), F.try_divide((F.col("attempts") - F.col("unknown")).cast("double"), "attempts").alias("coverage"))
