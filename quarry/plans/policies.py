"""Queries: thresholds, rules, baselines, the two-revision gate, lifecycles, suppressions and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import value as V
from quarry.operators import policy as P
from quarry.operators import windows
from quarry.plans import adapters as A
from quarry.plans.catalogue import register

BOUNDS = "code string, min double, max double"
CLASS_THRESHOLDS = [("WMC", None, 30.0), ("NOM", None, 14.0), ("CCC", 5.0, 60.0), ("CLOC", 100.0, None)]
RULES = [("God Class", "WMC", 28.0, None), ("God Class", "NOM", 12.0, None), ("Lazy Class", "NOM", None, 6.0), ("Lazy Class", "CLOC", None, 500.0), ("Heavy", "CLOC", 1200.0, None)]
RULE_SCHEMA = "rule string, code string, min double, max double"
_T = "t(code, min, max) AS (VALUES ('WMC', NULL::DOUBLE, 30.0::DOUBLE), ('NOM', NULL, 14.0), ('CCC', 5.0, 60.0), ('CLOC', 100.0, NULL))"
_OUT = "greatest(coalesce(value - max, 0), coalesce(min - value, 0), 0)"
_IN = "(coalesce(value >= min, true) AND coalesce(value <= max, true))"
_SEV = "CASE WHEN x >= 2 THEN 'high' WHEN x >= 1.2 THEN 'medium' ELSE 'low' END"
_EXCESS = "CASE WHEN value > max AND max > 0 THEN value / max WHEN value < min AND value > 0 THEN min / value ELSE 1.0 END"
_VAL = f"""WITH {A.METHODS_SQL}, {_T}, v AS (
SELECT entity_id, x.code, value::DOUBLE AS value, min, max, {_IN} AS passed, {_OUT}::DOUBLE AS overshoot, ({_EXCESS})::DOUBLE AS x FROM x JOIN t ON t.code = x.code)"""


def _checked(spark, sf_dir):
    return P.violations(A.class_metrics(spark, sf_dir), A.dimension(spark, CLASS_THRESHOLDS, BOUNDS))


@register("threshold_validate", f"{_VAL} SELECT entity_id, code, value, min, max, overshoot, {_SEV} AS severity FROM v WHERE NOT passed")
def threshold_validate(spark, sf_dir):
    return _checked(spark, sf_dir).filter("not passed").drop("passed")


@register("validate_status", f"""{_VAL} SELECT count(*) AS checked, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS status FROM v""")
def validate_status(spark, sf_dir):
    status = F.when(F.bool_and("passed"), "passed").otherwise("failed")
    return _checked(spark, sf_dir).agg(F.count("*").alias("checked"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), status.alias("status"))


@register("validate_by_file", f"{_VAL} SELECT entity_id AS file, string_agg(code, ',' ORDER BY code) AS failed FROM v WHERE NOT passed GROUP BY 1")
def validate_by_file(spark, sf_dir):
    return _checked(spark, sf_dir).filter("not passed").groupBy(F.col("entity_id").alias("file")).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("failed"))


@register("severity_ratio", f"SELECT o_orderkey, {_SEV} AS severity FROM (SELECT o_orderkey, {_EXCESS} AS x FROM (SELECT o_orderkey, o_totalprice - 100000 AS value, 20000.0 AS min, 100000.0 AS max FROM orders))")
def severity_ratio(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", V.severity(F.col("o_totalprice") - 100000, F.lit(20000.0), F.lit(100000.0)).alias("severity"))


_RULES_SQL = "rl(rule, code, min, max) AS (VALUES ('God Class', 'WMC', 28.0::DOUBLE, NULL::DOUBLE), ('God Class', 'NOM', 12.0, NULL), ('Lazy Class', 'NOM', NULL, 6.0), ('Lazy Class', 'CLOC', NULL, 500.0), ('Heavy', 'CLOC', 1200.0, NULL))"
_DETECT = f"""WITH {A.METHODS_SQL}, {_RULES_SQL}, h AS (SELECT rule, entity_id, count(*) AS held, max(greatest(1.0, CASE WHEN min > 0 THEN value / min ELSE 1.0 END, CASE WHEN max > 0 AND value > 0 THEN max / value ELSE 1.0 END)) AS x FROM x JOIN rl ON rl.code = x.code WHERE {_IN} GROUP BY ALL),
f AS (SELECT rule, entity_id, x::DOUBLE AS x, {_SEV} AS severity FROM h WHERE held = (SELECT count(*) FROM rl WHERE rl.rule = h.rule))"""


def _detected(spark, sf_dir):
    found = P.satisfied(A.class_metrics(spark, sf_dir), A.dimension(spark, RULES, RULE_SCHEMA))
    return found.select("rule", "entity_id", "excess", V.severity_of(F.col("excess")).alias("severity"))


@register("combination_detect", f"{_DETECT} SELECT rule, entity_id, round(x, 9) AS excess, severity FROM f")
def combination_detect(spark, sf_dir):
    return _detected(spark, sf_dir).withColumn("excess", F.round("excess", 9))


@register("matches_by_rule", f"{_DETECT} SELECT rl.rule, count(DISTINCT entity_id) AS matches, count(DISTINCT entity_id) > 0 AS matched FROM (SELECT DISTINCT rule FROM rl) rl LEFT JOIN f ON f.rule = rl.rule GROUP BY 1")
def matches_by_rule(spark, sf_dir):
    rules = A.dimension(spark, RULES, RULE_SCHEMA).select("rule").distinct()
    counted = _detected(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("matches"))
    return rules.join(counted, "rule", "left").select("rule", F.coalesce("matches", F.lit(0)).alias("matches"), (F.coalesce("matches", F.lit(0)) > 0).alias("matched"))


@register("worst_by_entity", f"{_DETECT} SELECT entity_id, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::INTEGER AS worst, string_agg(rule, ',' ORDER BY rule) AS rules FROM f GROUP BY 1")
def worst_by_entity(spark, sf_dir):
    return _detected(spark, sf_dir).groupBy("entity_id").agg(F.max(V.severity_rank(F.col("severity"))).alias("worst"), F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))


@register("rule_problems", """SELECT rule, code, problem FROM (VALUES ('A', 'XYZ', 'unknown metric'), ('B', 'WMC', 'no bound'), ('C', 'NOM', 'inverted bounds')) AS t(rule, code, problem)""")
def rule_problems(spark, sf_dir):
    conditions = A.dimension(spark, [("A", "XYZ", 1.0, None), ("B", "WMC", None, None), ("C", "NOM", 5.0, 2.0), ("D", "NOM", 2.0, 5.0)], RULE_SCHEMA)
    return P.rule_problems(conditions, A.class_metrics(spark, sf_dir).select("code").distinct())


GATE_T = [("WMC", None, 150.0), ("NOM", None, 4.0)]
_GT = "t(code, min, max) AS (VALUES ('WMC', NULL::DOUBLE, 150.0::DOUBLE), ('NOM', NULL, 4.0))"
_VIOL = "SELECT entity_id, {s}.code, value, min, max FROM {s} JOIN t ON t.code = {s}.code WHERE NOT (coalesce(value >= min, true) AND coalesce(value <= max, true))"
_BASE = f"""WITH {A.REVISIONS_SQL}, {_GT}, nv AS ({_VIOL.format(s='n')}), bv AS ({_VIOL.format(s='b')}),
d AS (SELECT coalesce(nv.entity_id, bv.entity_id) AS entity_id, coalesce(nv.code, bv.code) AS code, nv.value AS value, bv.value AS base_value,
  CASE WHEN nv.value IS NULL THEN 'RESOLVED' WHEN bv.value IS NULL THEN 'NEW_VIOLATION' WHEN nv.value > bv.value THEN 'DEGRADED' WHEN nv.value = bv.value THEN 'UNCHANGED' ELSE 'IMPROVED' END AS status
  FROM nv FULL JOIN bv ON nv.entity_id = bv.entity_id AND nv.code = bv.code)"""


def _compared(spark, sf_dir):
    """Violations of either revision, from one pass over both."""
    rows = A.compared(spark, sf_dir).join(A.dimension(spark, GATE_T, BOUNDS), "code")
    return P.baseline_rows(rows)


@register("baseline_compare", f"{_BASE} SELECT * FROM d")
def baseline_compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@register("baseline_counts", f"{_BASE} SELECT status, count(*) AS n FROM d GROUP BY 1")
def baseline_counts(spark, sf_dir):
    return _compared(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


_GATE = f"""WITH {A.REVISIONS_SQL}, {_GT}, j AS (
SELECT n.entity_id, n.code, n.value, b.value AS was, EXISTS (SELECT 1 FROM b o WHERE o.entity_id = n.entity_id) AS old, max AS hi, CASE n.code WHEN 'WMC' THEN 50.0::DOUBLE END AS budget
FROM n LEFT JOIN b ON b.entity_id = n.entity_id AND b.code = n.code LEFT JOIN t ON t.code = n.code),
g AS (SELECT entity_id, code, 'NEW_VIOLATION' AS type, was, value, value / hi AS x, value - hi AS magnitude FROM j WHERE NOT old AND value > hi
UNION ALL SELECT entity_id, code, 'THRESHOLD_CROSSING', was, value, value / hi, value - hi FROM j WHERE was <= hi AND value > hi
UNION ALL SELECT entity_id, code, 'GROWTH_BUDGET', was, value, (value - was) / budget, value - was FROM j WHERE value - was > budget
UNION ALL SELECT entity_id, code, 'WORSENED', was, value, NULL, NULL FROM j WHERE value > was AND NOT (was <= hi AND value > hi) AND NOT coalesce(value - was > budget, false)),
gf AS (SELECT entity_id, code, type, was AS base_value, value, CASE WHEN x IS NOT NULL THEN {_SEV} END AS severity, magnitude, type IN ('NEW_VIOLATION', 'THRESHOLD_CROSSING') AS blocking FROM g)"""


def _gate(spark, sf_dir):
    return P.gate_rows(A.compared(spark, sf_dir), A.dimension(spark, GATE_T, BOUNDS), A.dimension(spark, [("WMC", 50.0)], "code string, budget double"), ["NEW_VIOLATION", "THRESHOLD_CROSSING"])


for _name, _kind in (("gate_new", "NEW_VIOLATION"), ("gate_crossing", "THRESHOLD_CROSSING"), ("gate_growth", "GROWTH_BUDGET"), ("gate_worsened", "WORSENED")):
    register(_name, f"{_GATE} SELECT * FROM gf WHERE type = '{_kind}'")(lambda spark, sf_dir, kind=_kind: _gate(spark, sf_dir).filter(F.col("type") == kind))


@register("gate_ranked", f"{_GATE} SELECT * FROM gf ORDER BY blocking DESC, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END DESC NULLS LAST, magnitude DESC NULLS LAST, code, entity_id, type")
def gate_ranked(spark, sf_dir):
    return P.ranked(_gate(spark, sf_dir))


@register("findings_summary", f"""{_GATE} SELECT count(*) AS total, count(*) FILTER (blocking) AS blocking, count(*) FILTER (NOT blocking) AS advisory, count(DISTINCT entity_id) AS entities, count(*) FILTER (severity = 'high') AS high,
count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity IS NULL) AS unrated, count(*) FILTER (type = 'NEW_VIOLATION') AS fresh, count(*) FILTER (type = 'THRESHOLD_CROSSING') AS crossing,
count(*) FILTER (type = 'GROWTH_BUDGET') AS grown, count(*) FILTER (type = 'WORSENED') AS worsened, true AS reconciled FROM gf""")
def findings_summary(spark, sf_dir):
    return P.findings_summary(_gate(spark, sf_dir))


@register("status_fold", f"{_GATE} SELECT CASE WHEN count(*) FILTER (blocking) > 0 THEN 'FAILED' WHEN count(*) FILTER (severity IS NULL) > 0 THEN 'INCOMPLETE' ELSE 'PASSED' END AS status, CASE WHEN count(*) FILTER (blocking) > 0 THEN 1 WHEN count(*) FILTER (severity IS NULL) > 0 THEN 2 ELSE 0 END AS exit_code FROM gf")
def status_fold(spark, sf_dir):
    counts = _gate(spark, sf_dir).agg(F.count_if("blocking").alias("b"), F.count_if(F.col("severity").isNull()).alias("i"))
    status = P.status_fold(F.col("b"), F.col("i"))
    return counts.select(status.alias("status"), F.when(status == "FAILED", 1).when(status == "INCOMPLETE", 2).otherwise(0).alias("exit_code"))


_ENT_SQL = """
be AS (SELECT DISTINCT c_nationkey::VARCHAR AS path, p_brand || '/' || p_size || '/' || p_type AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'),
ce AS (SELECT DISTINCT c_nationkey::VARCHAR AS path, p_brand || '/' || p_size || '/' || p_type AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'O'),
mv AS (SELECT n_nationkey::VARCHAR AS old_path, ((n_nationkey + 1) % 25)::VARCHAR AS new_path FROM nation WHERE n_nationkey % 2 = 0)
"""


def _entities(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    items = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(A.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(A.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), "p_type").alias("name")), F.col("l_partkey") == F.col("p_partkey"))
        .select("o_orderstatus", F.col("c_nationkey").cast("string").alias("path"), "name").distinct()
    )
    moves = A.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("old_path"), ((F.col("n_nationkey") + 1) % 25).cast("string").alias("new_path"), F.col("n_nationkey").alias("seq"))
    return *(joined.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O")), moves


_CORR = f"""WITH {_ENT_SQL}, s AS (SELECT path, name, path AS base_path, 'SAME' AS kind FROM ce SEMI JOIN be USING (path, name)),
ro AS (SELECT * FROM be ANTI JOIN ce USING (path, name)), rn AS (SELECT * FROM ce ANTI JOIN be USING (path, name)),
mo AS (SELECT rn.path, rn.name, max(ro.path) AS base_path, 'MOVED' AS kind FROM rn JOIN mv ON mv.new_path = rn.path JOIN ro ON ro.path = mv.old_path AND ro.name = rn.name GROUP BY ALL),
al AS (SELECT * FROM s UNION ALL SELECT * FROM mo UNION ALL SELECT path, name, NULL, 'ADDED' FROM rn ANTI JOIN mo USING (path, name)
UNION ALL SELECT NULL, name, path, 'REMOVED' FROM ro WHERE NOT EXISTS (SELECT 1 FROM mo WHERE mo.base_path = ro.path AND mo.name = ro.name))"""


@register("entity_correspondence", f"{_CORR} SELECT path, name, base_path, kind FROM al WHERE kind IN ('SAME', 'MOVED')")
def entity_correspondence(spark, sf_dir):
    return P.correspondence(*_entities(spark, sf_dir)).filter("kind in ('SAME', 'MOVED')")


@register("removed_added", f"{_CORR} SELECT coalesce(path, base_path) AS path, name, kind FROM al WHERE kind IN ('REMOVED', 'ADDED')")
def removed_added(spark, sf_dir):
    return P.correspondence(*_entities(spark, sf_dir)).filter("kind in ('REMOVED', 'ADDED')").select(F.coalesce("path", "base_path").alias("path"), "name", "kind")


_LIFE = f"""WITH {A.REVISIONS_SQL}, w AS (SELECT coalesce(rn.entity_id, rb.entity_id) AS entity_id, rn."WMC" AS wn, rn."NOM" AS nn, rb."WMC" AS wb, rb."NOM" AS nb
FROM (SELECT * FROM r WHERE rev = 'O') rn FULL JOIN (SELECT * FROM r WHERE rev = 'F') rb ON rn.entity_id = rb.entity_id),
s AS (SELECT *, CASE WHEN wn IS NULL THEN NULL WHEN wn >= 60 AND nn >= 2 THEN 'MATCH' ELSE 'NONMATCH' END AS sn, CASE WHEN wb IS NULL THEN NULL WHEN wb >= 60 AND nb >= 2 THEN 'MATCH' ELSE 'NONMATCH' END AS sb FROM w),
l AS (SELECT *, CASE WHEN sb IS NULL THEN CASE WHEN sn = 'MATCH' THEN 'NEW_ENTITY' END WHEN sn IS NULL THEN CASE WHEN sb = 'MATCH' THEN 'RESOLVED' END
WHEN sb <> 'MATCH' AND sn = 'MATCH' THEN 'INTRODUCED' WHEN sb = 'MATCH' AND sn <> 'MATCH' THEN 'RESOLVED' WHEN sb = 'MATCH' AND wn - wb >= 20 AND nn - nb >= 0 THEN 'WORSENED' WHEN sb = 'MATCH' THEN 'EXISTING' END AS lifecycle FROM s)"""


def _both_revisions(spark, sf_dir):
    return A.both_revisions(spark, sf_dir)


def _columns(suffix):
    return {c: F.col(f"{c}{suffix}") for c in ("WMC", "NOM")}


@register("finding_lifecycle", f"{_LIFE} SELECT entity_id, lifecycle FROM l WHERE lifecycle IS NOT NULL")
def finding_lifecycle(spark, sf_dir):
    status = lambda s: F.when(F.col(f"WMC{s}").isNull(), None).when((F.col(f"WMC{s}") >= 60) & (F.col(f"NOM{s}") >= 2), "MATCH").otherwise("NONMATCH")
    worse = P.worsened(_columns("b"), _columns("n"), {"WMC": 20.0}, "RISES_BY_WHILE_OTHERS_HOLD", conditions=("WMC", "NOM"))
    removed = F.col("WMCn").isNull()  # a removed entity that matched is resolved
    life = F.when(removed, F.when(status("b") == "MATCH", "RESOLVED")).otherwise(P.lifecycle(status("b"), status("n"), worse))
    return _both_revisions(spark, sf_dir).select("entity_id", life.alias("lifecycle")).filter("lifecycle is not null")


for _name, _kind, _sql in (
    ("worsening_any", "RISES_BY", "wn - wb >= 20 OR nn - nb >= 2"),
    ("worsening_hold", "RISES_BY_WHILE_OTHERS_HOLD", "(wn - wb >= 20 OR nn - nb >= 2) AND wn - wb >= 0"),
    ("worsening_all", "ALL_RISE_BY", "wn - wb >= 20 AND nn - nb >= 2"),
):
    register(_name, f"{_LIFE} SELECT entity_id FROM l WHERE coalesce({_sql}, false)")(
        lambda spark, sf_dir, kind=_kind: _both_revisions(spark, sf_dir).filter(P.worsened(_columns("b"), _columns("n"), {"WMC": 20.0, "NOM": 2.0}, kind, conditions=("WMC", "NOM"))).select("entity_id")
    )


@register("rule_evaluate", f"""WITH {A.METHODS_SQL}, {_RULES_SQL}, e AS (SELECT entity_id, CASE WHEN code = 'NOM' AND value < 4 THEN NULL ELSE value END AS value, code FROM x),
j AS (SELECT rule, w.entity_id, value, min, max FROM (SELECT DISTINCT entity_id FROM x) w CROSS JOIN rl LEFT JOIN e ON e.entity_id = w.entity_id AND e.code = rl.code)
SELECT rule, entity_id, CASE WHEN NOT bool_and(value IS NOT NULL) THEN 'UNAVAILABLE' WHEN bool_and({_IN}) THEN 'MATCH' ELSE 'NONMATCH' END AS status FROM j GROUP BY ALL""")
def rule_evaluate(spark, sf_dir):
    metrics = A.class_metrics(spark, sf_dir)
    known = metrics.withColumn("value", F.when(~((F.col("code") == "NOM") & (F.col("value") < 4)), F.col("value")))
    return P.evaluate(known, metrics.select("entity_id").distinct(), A.dimension(spark, RULES, RULE_SCHEMA))


_DAY = "2026-01-15"
_SUPP = f"""{_GATE}, bf AS (SELECT * FROM gf WHERE blocking), sp(ix, rule, entity_id, expires) AS (
SELECT 2 * (hash_ix % 50), type, entity_id, CASE hash_ix % 3 WHEN 0 THEN DATE '2026-01-31' WHEN 1 THEN DATE '2024-01-01' END FROM (SELECT type, entity_id, length(entity_id) + ascii(right(entity_id, 1)) * 7 + ascii(entity_id) * 13 AS hash_ix FROM bf WHERE code = 'WMC' AND right(entity_id, 1) IN ('1', '4'))
UNION ALL SELECT 1, 'NEW_VIOLATION', 'nothing', NULL),
ap AS (SELECT bf.entity_id, code, type, min(ix) AS ix FROM bf JOIN sp ON sp.entity_id = bf.entity_id AND sp.rule = bf.type AND coalesce(DATE '2026-01-15' <= expires, true) GROUP BY ALL)"""


def _suppressions(spark, found):
    """Hand-written entries stand for a rule and an entity exactly; here they are drawn from the findings by their own text."""
    ix = F.length("entity_id") + F.ascii(F.right("entity_id", F.lit(1))) * 7 + F.ascii("entity_id") * 13
    day = F.when(ix % 3 == 0, F.lit("2026-01-31")).when(ix % 3 == 1, F.lit("2024-01-01")).cast("date")
    drawn = found.filter((F.col("code") == "WMC") & F.right("entity_id", F.lit(1)).isin("1", "4")).select((2 * (ix % 50)).alias("ix"), F.col("type").alias("rule"), "entity_id", day.alias("expires"))
    return drawn.unionByName(A.dimension(spark, [(1, "NEW_VIOLATION", "nothing")], "ix int, rule string, entity_id string").withColumn("expires", F.lit(None).cast("date")))


def _suppressed(spark, sf_dir):
    """Blocking findings with the first active suppression of their rule and entity; the day is a parameter, not the clock."""
    found = _gate(spark, sf_dir).filter("blocking").select("entity_id", "code", "type")
    rules = _suppressions(spark, found)
    return P.suppressed(found, rules, F.lit(_DAY).cast("date")), rules


@register("suppression_apply", f"{_SUPP} SELECT entity_id, code, type, ix FROM ap")
def suppression_apply(spark, sf_dir):
    return _suppressed(spark, sf_dir)[0]


@register("suppression_status", f"{_SUPP} SELECT sp.ix, sp.rule, sp.entity_id, CASE WHEN (sp.ix, sp.rule, sp.entity_id) IN (SELECT (ix, type, entity_id) FROM ap) THEN 'APPLIED' WHEN expires < DATE '2026-01-15' THEN 'STALE' ELSE 'UNUSED' END AS status FROM sp")
def suppression_status(spark, sf_dir):
    applied, rules = _suppressed(spark, sf_dir)
    return P.suppression_status(applied, rules, F.lit(_DAY).cast("date"))


@register("finding_baseline_accept", f"{_BASE} SELECT entity_id, code, status, status IN ('UNCHANGED', 'IMPROVED') AS accepted FROM d WHERE status <> 'RESOLVED'")
def finding_baseline_accept(spark, sf_dir):
    return _compared(spark, sf_dir).filter("status != 'RESOLVED'").select("entity_id", "code", "status", F.col("status").isin("UNCHANGED", "IMPROVED").alias("accepted"))


@register("stale_baseline", f"{_BASE} SELECT entity_id, code FROM bv ANTI JOIN nv USING (entity_id, code)")
def stale_baseline(spark, sf_dir):
    return _compared(spark, sf_dir).filter("status = 'RESOLVED'").select("entity_id", "code")


@register("fingerprint_sha256", """SELECT p_partkey, sha256('["v1","MT-C002",1,"v1",' || to_json(p_type)::VARCHAR || ',' || to_json(p_name)::VARCHAR || ',""]') AS fingerprint FROM part""")
def fingerprint_sha256(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    made = P.fingerprint(F.lit("MT-C002"), F.lit(1), F.col("p_type"), F.col("p_name"), F.lit(None).cast("string"))
    return part.select("p_partkey", made.alias("fingerprint"))


@register("manifest_diff", """WITH o AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), w AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.h IS NULL THEN 'A' WHEN w.h IS NULL THEN 'D' WHEN o.h = w.h THEN '=' ELSE 'M' END AS change FROM o FULL JOIN w ON o.path = w.path""")
def manifest_diff(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = F.col("doc_id").cast("string").alias("path")
    before = docs.filter("doc_id % 7 != 0").select(path, F.sha2("text", 256).alias("sha256"))
    after = docs.filter("doc_id % 5 != 0").select(path, F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return P.manifest_diff(before, after)


@register("manifest_digest", """WITH e AS (SELECT source, doc_id::VARCHAR AS path, sha256(text) AS h FROM documents), r AS (SELECT source, md5(path)[1:3] AS range, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path || ':' || h)) AS d, count(*) AS n FROM e GROUP BY ALL)
SELECT source, sha256(string_agg(range || ':' || d, chr(10) ORDER BY range)) AS digest, sum(n)::BIGINT AS files FROM r GROUP BY 1""")
def manifest_digest(spark, sf_dir):
    return P.manifest_digest(A.table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")), ["source"])


@register("completeness_required", f"""WITH {A.METHODS_SQL}, w AS (SELECT c_custkey::VARCHAR AS entity_id, u.code FROM customer, (VALUES ('NOM'), ('WMC'), ('DIT')) u(code))
SELECT code, CASE WHEN code = 'DIT' THEN 'METRIC_NOT_COMPUTED' ELSE 'ENTITY_NOT_MEASURED' END AS reason, count(*) AS gaps FROM w ANTI JOIN x USING (entity_id, code) GROUP BY ALL""")
def completeness_required(spark, sf_dir):
    entities = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.explode(F.array(*map(F.lit, ("NOM", "WMC", "DIT")))).alias("code"))
    metrics = A.class_metrics(spark, sf_dir).select("entity_id", "code")
    computed = metrics.select("code").distinct().withColumn("known", F.lit(True))
    missing = entities.join(metrics, ["entity_id", "code"], "left_anti").join(computed, "code", "left")
    reason = F.when(F.col("known").isNull(), "METRIC_NOT_COMPUTED").otherwise("ENTITY_NOT_MEASURED")
    return missing.groupBy("code", reason.alias("reason")).agg(F.count("*").alias("gaps"))


@register("findings_topk", f"{_GATE} SELECT entity_id, code, type, magnitude, greatest(count(*) OVER () - 20, 0) AS omitted FROM gf WHERE blocking OR type <> 'WORSENED' ORDER BY blocking DESC, magnitude DESC, entity_id, code, type LIMIT 20")
def findings_topk(spark, sf_dir):
    """The compact report: debt that only drifted is dropped, the first twenty of the rest are shown with the number left out."""
    found = _gate(spark, sf_dir).filter("blocking or type != 'WORSENED'")
    total = found.agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("omitted"))
    top = found.orderBy(F.col("blocking").desc(), F.col("magnitude").desc(), "entity_id", "code", "type").limit(20)
    return top.select("entity_id", "code", "type", "magnitude").crossJoin(F.broadcast(total))


@register("diagnostic_groups", "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL")
def diagnostic_groups(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup"))
    first = windows.dedupe_first(events, ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", F.col("event_id").alias("first_event"))
    return first.join(events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"])
