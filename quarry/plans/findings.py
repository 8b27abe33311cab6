"""Queries: findings of versioned rules with dispositions, baselines and orders; report views; inherited fields and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import findings as FN
from quarry.operators import graph, mood, windows
from quarry.plans import adapters as A
from quarry.plans import structure
from quarry.plans.catalogue import register
from quarry.sinks import documents
from quarry.sources import metric_catalogue

RULE = {"rule": "Q-1", "version": 1, "title": "Heavy brand", "level": "class", "maturity": "candidate", "worsening": "RISES_BY_WHILE_OTHERS_HOLD", "budgets": {"WMC": 20.0}, "conditions": [("WMC", 60.0, None), ("NOM", 2.0, None)], "mode": "error", "severity": "warning", "roles": None}
ROLES = [("SMALL", "[0-9]{1,2}"), ("LARGE", "[0-9]{4,}")]
_WIDE = f"""WITH {A.REVISIONS_SQL}, w AS (SELECT coalesce(rn.entity_id, rb.entity_id) AS id, rn."WMC" AS wn, rn."NOM" AS nn, rb."WMC" AS wb, rb."NOM" AS nb
FROM (SELECT * FROM r WHERE rev = 'O') rn FULL JOIN (SELECT * FROM r WHERE rev = 'F') rb ON rn.entity_id = rb.entity_id),
s AS (SELECT split_part(id, '/', 1) AS path, split_part(id, '/', 2) AS name, *, CASE WHEN wn >= 60 AND nn >= 2 THEN 'MATCH' WHEN wn IS NOT NULL THEN 'NONMATCH' END AS sn, CASE WHEN wb >= 60 AND nb >= 2 THEN 'MATCH' WHEN wb IS NOT NULL THEN 'NONMATCH' END AS sb,
  EXISTS (SELECT 1 FROM customer WHERE c_custkey::VARCHAR = split_part(id, '/', 1) AND c_acctbal >= 0) AS eligible FROM w),
l AS (SELECT *, CASE WHEN NOT eligible THEN CASE WHEN sn = 'MATCH' THEN 'EXISTING' END WHEN sn IS NULL THEN CASE WHEN sb = 'MATCH' THEN 'RESOLVED' END WHEN sb IS NULL THEN CASE WHEN sn = 'MATCH' THEN 'NEW_ENTITY' END
  WHEN sb <> 'MATCH' AND sn = 'MATCH' THEN 'INTRODUCED' WHEN sb = 'MATCH' AND sn <> 'MATCH' THEN 'RESOLVED' WHEN sb = 'MATCH' AND wn - wb >= 20 AND nn - nb >= 0 THEN 'WORSENED' WHEN sb = 'MATCH' THEN 'EXISTING' END AS lifecycle FROM s),
fd AS (SELECT path, name, lifecycle, coalesce(sn, 'NONMATCH') AS status, CASE WHEN NOT eligible THEN 'EXISTING' WHEN lifecycle = 'RESOLVED' THEN 'NOT_MATCHED' ELSE 'ACTIVE' END AS disposition, wn, nn, wb, nb,
  eligible AND sn = 'MATCH' AND lifecycle IN ('NEW_ENTITY', 'INTRODUCED', 'WORSENED') AS blocking, CASE WHEN length(path) <= 2 THEN 'SMALL' WHEN length(path) >= 4 THEN 'LARGE' ELSE 'UNKNOWN' END AS role,
  sha256('["v1","Q-1",1,"v1","' || path || '","' || name || '",""]') AS fingerprint FROM l WHERE lifecycle IS NOT NULL)"""


def _findings(spark, sf_dir):
    both = A.both_revisions(spark, sf_dir)
    parts = F.split("entity_id", "/")
    named = [parts[0].alias("path"), parts[1].alias("name"), F.lit(None).cast("string").alias("signature")]
    values = lambda s: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"{c}{s}").alias("value")) for c in ("WMC", "NOM"))), lambda e: e["value"].isNotNull()))
    pairs = both.select(*named, F.when(F.col("WMCn").isNotNull(), values("n")).alias("after"), parts[0].alias("base_path"), F.when(F.col("WMCb").isNotNull(), values("b")).alias("before"))
    changed = A.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("path"))
    return FN.evaluate(pairs, [RULE], ROLES, None, changed)


@register("finding_dispositions", f"{_WIDE} SELECT path, name, lifecycle, status, disposition, blocking, role, fingerprint FROM fd")
def finding_dispositions(spark, sf_dir):
    return _findings(spark, sf_dir).select("path", "name", "lifecycle", "status", "disposition", "blocking", "role", "fingerprint")


@register("finding_roles", f"{_WIDE} SELECT path, name, lifecycle FROM fd WHERE role = 'LARGE'")
def finding_roles(spark, sf_dir):
    """A rule that applies to some roles only has findings for those only."""
    return _findings(spark, sf_dir).filter("role = 'LARGE'").select("path", "name", "lifecycle")


@register("finding_counters", f"""{_WIDE} SELECT count(*) AS total, count(*) FILTER (blocking) AS blocking, count(DISTINCT path || '/' || name) AS entities, count(*) FILTER (disposition = 'ACTIVE') AS active, 0::BIGINT AS suppressed, 0::BIGINT AS accepted,
count(*) FILTER (disposition = 'NOT_MATCHED') AS not_matched, count(*) FILTER (disposition = 'EXISTING') AS outside, count(*) FILTER (lifecycle = 'NEW_ENTITY') AS new_entity, count(*) FILTER (lifecycle = 'INTRODUCED') AS introduced, count(*) FILTER (lifecycle = 'WORSENED') AS worsened,
count(*) FILTER (lifecycle = 'EXISTING') AS existing, count(*) FILTER (lifecycle = 'RESOLVED') AS resolved, 0::BIGINT AS comparison_unavailable, true AS reconciled FROM fd""")
def finding_counters(spark, sf_dir):
    return FN.summary(_findings(spark, sf_dir))


@register("finding_order", f"{_WIDE} SELECT path, name, row_number() OVER (ORDER BY blocking DESC, path, name, fingerprint) AS place FROM fd")
def finding_order(spark, sf_dir):
    """Every finding with its place in the report's total order."""
    rows = _findings(spark, sf_dir).select("path", "name", "blocking", "fingerprint")
    return windows.places(rows, [F.col("blocking").desc(), F.col("path"), F.col("name"), F.col("fingerprint")]).select("path", "name", "place")


@register("finding_compact", f"{_WIDE}, q AS (SELECT *, lifecycle = 'EXISTING' AS debt FROM fd) SELECT path, name, lifecycle, (SELECT count(*) FROM q WHERE NOT debt) AS shown_of, (SELECT count(*) FROM q WHERE debt) AS dropped FROM q WHERE NOT debt ORDER BY blocking DESC, path, name LIMIT 20")
def finding_compact(spark, sf_dir):
    """The compact report of twenty."""
    return FN.compact(_findings(spark, sf_dir), 20).select("path", "name", "lifecycle", "shown_of", "dropped")


_ACCEPTED = "bl AS (SELECT fingerprint, CASE WHEN name < 'Brand#3' THEN wn - 30 ELSE wn END AS w, nn AS n FROM fd WHERE status = 'MATCH' AND name < 'Brand#4')"


@register("finding_accepted", f"""{_WIDE}, {_ACCEPTED}, j AS (SELECT fd.*, bl.fingerprint IS NOT NULL AS known, coalesce(wn - w >= 20 AND nn - n >= 0, false) AS worse FROM fd LEFT JOIN bl ON bl.fingerprint = fd.fingerprint)
SELECT path, name, CASE WHEN known AND disposition = 'ACTIVE' AND NOT worse THEN 'ACCEPTED' ELSE disposition END AS disposition, CASE WHEN known AND disposition = 'ACTIVE' AND worse THEN 'WORSENED' ELSE lifecycle END AS lifecycle FROM j""")
def finding_accepted(spark, sf_dir):
    """Findings against a baseline of accepted values; those far beyond what was accepted stay active."""
    found = _findings(spark, sf_dir)
    lowered = F.map_from_arrays(F.array(F.lit("WMC"), F.lit("NOM")), F.array(F.col("accepted")["WMC"] - F.when(F.col("name") < "Brand#3", 30.0).otherwise(0.0), F.col("accepted")["NOM"]))
    baseline = FN.baseline_of(found).filter("name < 'Brand#4'").withColumn("accepted", lowered)
    return FN.accept(found, baseline, [RULE]).select("path", "name", "disposition", "lifecycle")


@register("finding_stale", f"{_WIDE}, bp AS (SELECT DISTINCT sha256('[\"v1\",\"Q-1\",1,\"v1\",\"' || c_custkey || '\",\"Brand#11\",\"\"]') AS fingerprint FROM customer) SELECT fingerprint FROM bp ANTI JOIN fd USING (fingerprint)")
def finding_stale(spark, sf_dir):
    """Baseline entries that no finding has any more."""
    from quarry.operators import policy

    path = F.col("c_custkey").cast("string")
    prints = policy.fingerprint(F.lit("Q-1"), F.lit(1), path, F.lit("Brand#11"), F.lit(None).cast("string"))
    return FN.stale(A.table(spark, sf_dir, "customer").select(prints.alias("fingerprint")), _findings(spark, sf_dir))


_ORDERS = "SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity, event_type AS code, props AS message, user_id::VARCHAR AS path, event_id % 100 AS line FROM events"


@register("diagnostics_order", f"SELECT event_id, row_number() OVER (ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, code, message, path, line, event_id) AS place FROM ({_ORDERS})")
def diagnostics_order(spark, sf_dir):
    """The total order of diagnostics: severity, code, message, path and line."""
    kind = F.col("event_type")
    rows = A.table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO").alias("severity"), kind.alias("code"), F.col("props").alias("message"), F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 100).alias("line"))
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return windows.places(rows, [rank, *map(F.col, ("code", "message", "path", "line", "event_id"))]).select("event_id", "place")


@register("diagnostic_flags", f"SELECT count(*) > 0 AS any, count(*) FILTER (severity = 'WARNING') > 0 AS warnings, count(*) FILTER (severity = 'ERROR') > 0 AS errors FROM ({_ORDERS})")
def diagnostic_flags(spark, sf_dir):
    kind = F.col("event_type")
    return documents.diagnostic_counts(A.table(spark, sf_dir, "events").select(F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO").alias("severity")))


@register("diagnostic_distinct_cap", """WITH d AS (SELECT user_id, event_type, props, min(event_id) AS first FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS k FROM d)
SELECT user_id, count(*) FILTER (k <= 20) AS kept, count(*) FILTER (k > 20) AS omitted FROM n GROUP BY 1""")
def diagnostic_distinct_cap(spark, sf_dir):
    """Distinct diagnostics of a subject, the first twenty kept and the rest counted."""
    distinct = A.table(spark, sf_dir, "events").groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("first"))
    kept = windows.capped(distinct, ["user_id"], [F.col("first")], 20).groupBy("user_id").agg(F.count("*").alias("kept"))
    return kept.join(windows.omitted(distinct, ["user_id"], 20), "user_id", "left").select("user_id", "kept", F.coalesce("omitted", F.lit(0)).alias("omitted"))


@register("evidence_with_extreme", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
SELECT l_orderkey, count(*) FILTER (n <= 3) AS kept, greatest(count(*) - 3, 0) AS omitted, max(l_quantity) AS extreme FROM k GROUP BY 1""")
def evidence_with_extreme(spark, sf_dir):
    """Evidence capped by entity, with the number left out and the extreme of all, whether kept or not."""
    items = A.table(spark, sf_dir, "lineitem")
    kept = F.least(F.count("*"), F.lit(3))
    return items.groupBy("l_orderkey").agg(kept.alias("kept"), (F.count("*") - kept).alias("omitted"), F.max("l_quantity").alias("extreme"))


_LEVELS = f"""WITH {A.METHODS_SQL}, mt AS (SELECT method::VARCHAR AS entity_id, 'Long' AS rule, 0 AS ix, CASE WHEN "LOC" >= 300 THEN 3 WHEN "LOC" >= 180 THEN 2 ELSE 1 END AS rank FROM m WHERE "LOC" >= 150
UNION ALL SELECT method::VARCHAR, 'Branchy', 1, CASE WHEN "CC" >= 8 THEN 3 WHEN "CC" >= 4.8 THEN 2 ELSE 1 END FROM m WHERE "CC" >= 4)"""


def _method_matches(spark, sf_dir):
    rows = A.methods(spark, sf_dir)
    level = lambda ratio: F.when(ratio >= 2, "high").when(ratio >= 1.2, "medium").otherwise("low")
    long = rows.filter("LOC >= 150").select(F.col("method").cast("string").alias("entity_id"), F.lit("Long").alias("rule"), F.lit(0).alias("ix"), level(F.col("LOC") / 150).alias("severity"))
    branchy = rows.filter("CC >= 4").select(F.col("method").cast("string").alias("entity_id"), F.lit("Branchy").alias("rule"), F.lit(1).alias("ix"), level(F.col("CC") / 4).alias("severity"))
    return long.unionByName(branchy).withColumn("level", F.lit("method"))


@register("detection_by_method", f"{_LEVELS} SELECT entity_id, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst, string_agg(rule, ',' ORDER BY ix) AS rules, row_number() OVER (ORDER BY max(rank), entity_id) AS place FROM mt GROUP BY entity_id")
def detection_by_method(spark, sf_dir):
    """Matches by method, the least severe first, as that view is defined."""
    rows = documents.by_entity(_method_matches(spark, sf_dir), "method")
    rank = F.when(F.col("worst") == "high", 3).when(F.col("worst") == "medium", 2).otherwise(1)
    return windows.places(rows.select("entity_id", "worst", F.array_join("rules", ",").alias("rules")), [rank, F.col("entity_id")])


@register("rules_summary", f"{_LEVELS} SELECT 3::BIGINT AS total, count(DISTINCT rule) AS matched, count(*) AS findings, count(DISTINCT entity_id) AS affected FROM mt")
def rules_summary(spark, sf_dir):
    """Rules given and matched, findings and entities affected."""
    rules = A.dimension(spark, [("Long",), ("Branchy",), ("Never",)], "rule string").agg(F.count("*").alias("total"))
    found = _method_matches(spark, sf_dir).agg(F.count_distinct("rule").alias("matched"), F.count("*").alias("findings"), F.count_distinct("entity_id").alias("affected"))
    return rules.crossJoin(F.broadcast(found))


@register("metric_order", f"WITH {A.METHODS_SQL}, o(code, ordinal, unit) AS (VALUES ('WMC', 27, 'value'), ('NOM', 38, 'declarations'), ('CLOC', 19, 'lines'), ('CCC', 20, 'value')) SELECT entity_id, x.code, ordinal, unit, value::DOUBLE AS value FROM x JOIN o ON o.code = x.code")
def metric_order(spark, sf_dir):
    """Metric rows with their place in the catalogue and their unit."""
    catalogue = metric_catalogue.table(spark)
    return A.class_metrics(spark, sf_dir).join(catalogue.select("code", "ordinal", "unit"), "code").select("entity_id", "code", "ordinal", "unit", "value")


@register("parse_issues", "SELECT user_id::VARCHAR AS path, count(*) AS errors FROM events WHERE event_type LIKE 'err%' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1")
def parse_issues(spark, sf_dir):
    """Diagnostics of one family of codes, of the subjects of a run."""
    subjects = A.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    return A.table(spark, sf_dir, "events").filter(F.col("event_type").startswith("err")).join(subjects, "user_id", "left_semi").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.count("*").alias("errors"))


@register("ancestry_distance", f"WITH RECURSIVE {A.TREE_SQL}, t AS (SELECT dst AS class, src AS ancestor, 1::BIGINT AS distance FROM e UNION ALL SELECT t.class, e.src, t.distance + 1 FROM t JOIN e ON e.dst = t.ancestor) SELECT class, ancestor, distance FROM t")
def ancestry_distance(spark, sf_dir):
    """Every ancestor with its distance."""
    up = A.tree(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.levels(up).select(F.col("src").alias("class"), F.col("dst").alias("ancestor"), "distance")


@register("mood_field_inheritance", f"""{structure.CLOSURE_SQL.replace('WITH RECURSIVE', f'WITH RECURSIVE {structure.MEMBERS_SQL},')},
i AS (SELECT count(*) AS i FROM t JOIN mb ON mb.class = t.src JOIN k a ON a.class = t.src JOIN k b ON b.class = t.dst WHERE mb.visibility IN ('public', 'protected') OR (mb.visibility = 'package' AND a.package = b.package)), o AS (SELECT count(*) AS o FROM mb)
SELECT i AS inherited, i + o AS available, coalesce(i::DOUBLE / nullif(i + o, 0), 0) AS factor FROM i, o""")
def mood_field_inheritance(spark, sf_dir):
    """Inherited fields over available ones; hidden fields count every time."""
    classes, fields = structure._members(spark, sf_dir)
    lines = graph.closure(A.tree(spark, sf_dir)).select(F.col("dst").alias("class"), F.col("src").alias("ancestor"))
    inside = lines.join(classes.select(F.col("class").alias("ancestor")), "ancestor", "left_semi")
    return mood.field_inheritance(fields, classes, inside.select("class", "ancestor"))
