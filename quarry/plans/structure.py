"""Queries: joins, coupling, inheritance, cohesion and other graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph, mood, rollup
from quarry.plans import adapters as A
from quarry.plans.catalogue import register

CLOSURE_SQL = f"WITH RECURSIVE {A.TREE_SQL}, t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON e.src = t.dst)"


@register("package_coupling", f"""WITH {A.PACKAGE_EDGES_SQL}, p AS (SELECT n_nationkey AS package FROM nation),
ce AS (SELECT src, count(*) AS ce FROM pe WHERE src <> dst GROUP BY 1), ca AS (SELECT dst, count(*) AS ca FROM pe WHERE src <> dst GROUP BY 1),
a AS (SELECT c_nationkey, (count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')))::DOUBLE / count(*) AS a FROM customer GROUP BY 1),
j AS (SELECT package, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, coalesce(a, 0) AS a FROM p LEFT JOIN ce ON src = package LEFT JOIN ca ON dst = package LEFT JOIN a ON c_nationkey = package)
SELECT package, ce, ca, coalesce(ce::DOUBLE / nullif(ce + ca, 0), 0) AS instability, a AS abstractness, round(abs(1 - coalesce(ce::DOUBLE / nullif(ce + ca, 0), 0) - a), 9) AS distance FROM j""")
def package_coupling(spark, sf_dir):
    packages = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("package"))
    kinds = A.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("package")).agg((F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).cast("double") / F.count("*")).alias("abstractness"))
    joined = rollup.coupling(A.package_edges(spark, sf_dir), packages).join(kinds, "package", "left").na.fill(0.0, ["abstractness"])
    return joined.withColumn("distance", F.round(F.abs(1 - F.col("instability") - F.col("abstractness")), 9))


@register("noc_children", f"WITH {A.TREE_SQL} SELECT p_partkey AS class, coalesce(n, 0) AS noc FROM part LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM e GROUP BY 1) ON src = p_partkey")
def noc_children(spark, sf_dir):
    children = A.tree(spark, sf_dir).groupBy("src").agg(F.count_distinct("dst").alias("noc"))
    return A.table(spark, sf_dir, "part").join(children, F.col("p_partkey") == F.col("src"), "left").select(F.col("p_partkey").alias("class"), F.coalesce("noc", F.lit(0)).alias("noc"))


def _foreign_data(spark, sf_dir, poison):
    """Foreign readers of each package's data; undefined when another package has an unresolved access."""
    edges = A.package_edges(spark, sf_dir)
    readers = edges.filter("src != dst").groupBy(F.col("dst").alias("package")).agg(F.count_distinct("src").alias("fdp"))
    largest = edges.agg(F.max("src").alias("largest"))  # one row
    unresolved = edges.crossJoin(F.broadcast(largest)).filter(poison).agg(F.count_distinct("src").alias("bad"), F.min("src").alias("only"))  # one row
    packages = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("package"))
    joined = packages.join(readers, "package", "left").crossJoin(F.broadcast(unresolved))
    other = (F.col("bad") > 1) | ((F.col("bad") == 1) & (F.col("only") != F.col("package")))
    return joined.select("package", F.when(~other, F.coalesce("fdp", F.lit(0))).alias("fdp"), F.when(other, "UNDEFINED").otherwise("DEFINED").alias("state"))


_FDP_SQL = f"""WITH {A.PACKAGE_EDGES_SQL}, u AS (SELECT count(DISTINCT src) AS bad, min(src) AS single FROM pe WHERE @),
q AS (SELECT n_nationkey AS package, (SELECT count(DISTINCT src) FROM pe WHERE dst = n_nationkey AND src <> dst) AS fdp, bad > 1 OR (bad = 1 AND single <> n_nationkey) AS other FROM nation, u)
SELECT package, CASE WHEN NOT coalesce(other, false) THEN fdp END AS fdp, CASE WHEN coalesce(other, false) THEN 'UNDEFINED' ELSE 'DEFINED' END AS state FROM q"""


@register("fdp_clean", _FDP_SQL.replace("@", "src IS NULL"))
def fdp_clean(spark, sf_dir):
    return _foreign_data(spark, sf_dir, "src is null")


@register("fdp_poisoned", _FDP_SQL.replace("@", "src = (SELECT max(src) FROM pe)"))
def fdp_poisoned(spark, sf_dir):
    return _foreign_data(spark, sf_dir, "src = largest")


@register("descendants_closure", f"{CLOSURE_SQL} SELECT src, count(*) AS descendants, max(dst) AS last FROM t GROUP BY 1")
def descendants_closure(spark, sf_dir):
    return graph.closure(A.tree(spark, sf_dir)).groupBy("src").agg(F.count("*").alias("descendants"), F.max("dst").alias("last"))


@register("ancestors_closure", f"{CLOSURE_SQL} SELECT dst AS class, src AS ancestor FROM t")
def ancestors_closure(spark, sf_dir):
    return graph.closure(A.tree(spark, sf_dir)).select(F.col("dst").alias("class"), F.col("src").alias("ancestor"))


@register("dit_depth", f"""WITH RECURSIVE {A.TREE_SQL}, d AS (SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT dst FROM e) THEN 2 ELSE 1 END::BIGINT AS depth FROM part WHERE p_partkey NOT IN (SELECT dst FROM e WHERE src IN (SELECT p_partkey FROM part))
UNION ALL SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node) SELECT node, depth FROM d""")
def dit_depth(spark, sf_dir):
    nodes = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.depth(nodes, A.tree(spark, sf_dir).select(F.col("dst").alias("node"), F.col("src").alias("parent")))


FIELDS_SQL = """
f AS (SELECT DISTINCT o_custkey AS class, o_orderkey AS method, p_brand AS field FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
g AS (SELECT a.class, a.method AS a, b.method AS b FROM f a JOIN f b ON a.class = b.class AND a.field = b.field AND a.method < b.method GROUP BY ALL)
"""


def _field_use(spark, sf_dir):
    """(class, method, field): which fields each method uses."""
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = A.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("o_custkey").alias("class"), F.col("o_orderkey").alias("method"), F.col("p_brand").alias("field")).distinct()


@register("lcom_components", f"""WITH RECURSIVE {FIELDS_SQL}, t AS (SELECT DISTINCT class, method AS node, method AS label FROM f UNION SELECT t.class, CASE WHEN g.a = t.node THEN g.b ELSE g.a END, t.label FROM t JOIN g ON g.class = t.class AND t.node IN (g.a, g.b)),
l AS (SELECT class, node, min(label) AS label FROM t GROUP BY ALL)
SELECT class, count(DISTINCT label) AS lcom FROM l GROUP BY 1""")
def lcom_components(spark, sf_dir):
    used = graph.kept(_field_use(spark, sf_dir))
    # a field links its methods to the smallest one: linear in uses, where method pairs would be quadratic
    stars = used.join(used.groupBy("class", "field").agg(F.min("method").alias("b")), ["class", "field"]).filter("method != b").select(F.col("class").alias("grp"), F.col("method").alias("a"), "b")
    labels = graph.grouped_components(stars, used.select(F.col("class").alias("grp"), F.col("method").alias("node")))
    return labels.groupBy(F.col("grp").alias("class")).agg(F.count_distinct("component").alias("lcom"))


@register("tcc_ratio", f"""WITH {FIELDS_SQL}, n AS (SELECT class, count(DISTINCT method) AS n FROM f GROUP BY 1), p AS (SELECT class, count(*) AS p FROM g GROUP BY 1)
SELECT n.class, coalesce(p, 0) AS connected, CASE WHEN n < 2 THEN 0 ELSE coalesce(p, 0)::DOUBLE / (n * (n - 1) / 2) END AS tcc FROM n LEFT JOIN p ON p.class = n.class""")
def tcc_ratio(spark, sf_dir):
    return rollup.tight_cohesion(_field_use(spark, sf_dir)).select("class", "connected", "tcc")


MEMBERS_SQL = """
k AS (SELECT p_partkey AS class, p_size % 5 AS package FROM part),
mb AS (SELECT DISTINCT l_partkey AS class, 'm' || (l_suppkey % 20) AS signature, CASE l_suppkey % 20 % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'package' ELSE 'private' END AS visibility FROM lineitem)
"""


def _members(spark, sf_dir):
    """(class, package) and (class, signature, visibility)."""
    classes = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("class"), (F.col("p_size") % 5).alias("package"))
    kind = F.col("l_suppkey") % 20
    seen = F.when(kind % 4 == 0, "public").when(kind % 4 == 1, "protected").when(kind % 4 == 2, "package").otherwise("private")
    members = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("class"), F.concat(F.lit("m"), kind.cast("string")).alias("signature"), seen.alias("visibility")).distinct()
    return classes, members


@register("mood_hiding", f"""{CLOSURE_SQL.replace('WITH RECURSIVE', f'WITH RECURSIVE {MEMBERS_SQL},')},
n AS (SELECT count(*) AS n FROM k), pc AS (SELECT package, count(*) AS size FROM k GROUP BY 1),
od AS (SELECT t.src AS class, count(*) AS outside FROM t JOIN k a ON a.class = t.src JOIN k b ON b.class = t.dst WHERE a.package <> b.package GROUP BY 1),
v AS (SELECT CASE visibility WHEN 'public' THEN n - 1 WHEN 'package' THEN size - 1 WHEN 'protected' THEN size - 1 + coalesce(outside, 0) ELSE 0 END AS seen FROM mb JOIN k ON k.class = mb.class JOIN pc ON pc.package = k.package LEFT JOIN od ON od.class = k.class, n)
SELECT count(*) AS members, sum(seen)::BIGINT AS visible, CASE WHEN (SELECT n FROM n) <= 1 OR count(*) = 0 THEN 0 ELSE 1 - sum(seen)::DOUBLE / (count(*) * ((SELECT n FROM n) - 1)) END AS mhf FROM v""")
def mood_hiding(spark, sf_dir):
    classes, members = _members(spark, sf_dir)
    return mood.hiding(members, classes, _lines(spark, sf_dir)).withColumnRenamed("factor", "mhf")


def _lines(spark, sf_dir):
    """(class, ancestor) among the classes."""
    return graph.closure(A.tree(spark, sf_dir)).select(F.col("dst").alias("class"), F.col("src").alias("ancestor"))


INHERITED_SQL = "ih AS (SELECT DISTINCT t.dst AS class, mb.signature FROM t JOIN mb ON mb.class = t.src JOIN k a ON a.class = t.src JOIN k b ON b.class = t.dst WHERE mb.visibility IN ('public', 'protected') OR (mb.visibility = 'package' AND a.package = b.package))"


@register("mood_inheritance", f"""{CLOSURE_SQL.replace('WITH RECURSIVE', f'WITH RECURSIVE {MEMBERS_SQL},')}, {INHERITED_SQL},
i AS (SELECT count(*) AS i FROM ih WHERE NOT EXISTS (SELECT 1 FROM mb WHERE mb.class = ih.class AND mb.signature = ih.signature)), d AS (SELECT count(*) AS d FROM mb)
SELECT i AS inherited, i + d AS available, coalesce(i::DOUBLE / nullif(i + d, 0), 0) AS mif FROM i, d""")
def mood_inheritance(spark, sf_dir):
    classes, members = _members(spark, sf_dir)
    return mood.method_inheritance(members, classes, _lines(spark, sf_dir)).withColumnRenamed("factor", "mif")


@register("mood_polymorphism", f"""{CLOSURE_SQL.replace('WITH RECURSIVE', f'WITH RECURSIVE {MEMBERS_SQL},')}, {INHERITED_SQL},
o AS (SELECT mb.class, mb.signature, EXISTS (SELECT 1 FROM ih WHERE ih.class = mb.class AND ih.signature = mb.signature) AS over FROM mb),
ds AS (SELECT src AS class, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT count(*) FILTER (over) AS overriding, coalesce(sum(n) FILTER (NOT over), 0)::BIGINT AS possible FROM o LEFT JOIN ds ON ds.class = o.class)
SELECT overriding, possible, CASE WHEN possible = 0 THEN 1.0 ELSE overriding::DOUBLE / possible END AS pf FROM s""")
def mood_polymorphism(spark, sf_dir):
    classes, members = _members(spark, sf_dir)
    return mood.polymorphism(members.withColumn("is_static", F.lit(False)), classes, _lines(spark, sf_dir)).withColumnRenamed("factor", "pf")


@register("mood_coupling", f"WITH {A.PACKAGE_EDGES_SQL}, n AS (SELECT count(*) AS n FROM nation) SELECT count(*) AS couplings, count(*)::DOUBLE / (max(n) * (max(n) - 1) / 2) AS cf FROM pe, n WHERE src <> dst")
def mood_coupling(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").agg(F.count("*").alias("n"))
    pairs = A.package_edges(spark, sf_dir).filter("src != dst").agg(F.count("*").alias("couplings"))
    return pairs.crossJoin(F.broadcast(n)).select("couplings", (F.col("couplings") / (F.col("n") * (F.col("n") - 1) / 2)).alias("cf"))


@register("set_operations", f"""WITH {A.PACKAGE_EDGES_SQL}, s AS (SELECT c_custkey AS class, list(DISTINCT l_suppkey % 10) AS used FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT class, len(list_filter(used, lambda x: x <> class % 10)) AS foreign_used, NOT list_contains(used, class % 10) AS apart FROM s""")
def set_operations(spark, sf_dir):
    orders, items = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    used = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("class")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("used"))
    own = F.array(F.col("class") % 10)
    return used.select("class", F.size(F.array_except("used", own)).cast("long").alias("foreign_used"), (~F.arrays_overlap("used", own)).alias("apart"))
