"""Queries: roles, contexts, local changes, completeness and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import scope as S
from quarry.plans import adapters as A
from quarry.plans.catalogue import register

_P = "(CASE p_partkey % 5 WHEN 0 THEN 'src/main/java/' WHEN 1 THEN 'src/test/java/' WHEN 2 THEN 'mod/gen/' WHEN 3 THEN 'x/generated/' ELSE 'doc/' END || replace(p_name, ' ', '/') || CASE p_partkey % 7 WHEN 0 THEN '.lockfile' WHEN 1 THEN '/pom.xml' ELSE '.java' END)"


def _paths(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    head = F.element_at(F.array(*map(F.lit, ("src/main/java/", "src/test/java/", "mod/gen/", "x/generated/", "doc/"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    tail = F.when(F.col("p_partkey") % 7 == 0, ".lockfile").when(F.col("p_partkey") % 7 == 1, "/pom.xml").otherwise(".java")
    return part.select("p_partkey", F.concat(head, F.replace("p_name", F.lit(" "), F.lit("/")), tail).alias("path"))


@register("path_facts", f"""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (2, 3) THEN 'GENERATED' WHEN p_partkey % 5 = 1 THEN 'TEST' WHEN p_partkey % 5 = 0 THEN 'PRODUCTION' ELSE 'UNKNOWN' END AS role, p_partkey % 7 > 1 AS java, p_partkey % 7 <= 1 AS descriptor,
replace(CASE WHEN p_partkey % 7 > 1 THEN left({_P}, length({_P}) - 5) ELSE {_P} END, '/', '.') AS fqn FROM part""")
def path_facts(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("p_partkey", S.role(path).alias("role"), S.is_java(path).alias("java"), S.is_build_descriptor(path).alias("descriptor"), S.qualified_name(path).alias("fqn"))


@register("analysis_context", f"SELECT DISTINCT {_P} AS path, starts_with({_P}, 'src/main/java/small/') OR starts_with({_P}, 'mod/') AS inside FROM part")
def analysis_context(spark, sf_dir):
    return S.in_context(_paths(spark, sf_dir).select("path").distinct(), A.dimension(spark, [("src/main/java/small/",), ("mod",)], "root string"))


@register("local_changes", """WITH h AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS x FROM documents WHERE doc_id % 7 <> 0), w AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS x FROM documents WHERE doc_id % 5 <> 0),
j AS (SELECT CASE WHEN h.x IS NULL THEN 'A' WHEN w.x IS NULL THEN 'D' ELSE 'M' END AS status, h.path AS old_path, w.path AS new_path FROM h FULL JOIN w ON h.path = w.path WHERE h.x IS DISTINCT FROM w.x)
SELECT status, old_path, new_path FROM j WHERE NOT (status = 'D' AND old_path IN ('10', '15')) AND NOT (status = 'A' AND new_path IN ('14', '21')) UNION ALL VALUES ('R', '10', '14'), ('R', '15', '21')""")
def local_changes(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("path"), "text")
    head = docs.filter("doc_id % 7 != 0").select("path", F.sha2("text", 256).alias("sha256"))
    after = docs.filter("doc_id % 5 != 0").select("path", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return S.local_changes(A.dimension(spark, [("R", "10", "14"), ("R", "15", "21"), ("R", "10", "14")], "status string, old_path string, new_path string"), head, after)


@register("completeness_issues", """WITH s AS (SELECT c_custkey::VARCHAR AS path, c_custkey AS k, c_mktsegment AS seg FROM customer)
SELECT path AS file, NULL::VARCHAR AS code, 'current-parse-error' AS reason, true AS required FROM s WHERE k % 10 = 3
UNION ALL SELECT path, NULL, 'unsupported-declaration', true FROM s WHERE seg = 'MACHINERY'
UNION ALL SELECT path, c, CASE WHEN c = 'CC' THEN 'metric-unavailable-local' ELSE 'optional-unavailable' END, c = 'CC' FROM s, (VALUES ('CC', 4), ('LOC', 6)) t(c, m) WHERE k % 10 <> 3 AND k % m = 0""")
def completeness_issues(spark, sf_dir):
    s = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey", "c_mktsegment")
    parsed = s.filter("c_custkey % 10 != 3").select("path")
    measured = s.filter("c_custkey % 4 != 0").select("path", F.lit("CC").alias("code")).unionByName(s.filter("c_custkey % 6 != 0").select("path", F.lit("LOC").alias("code")))
    return S.completeness(s.select("path"), parsed, s.filter("c_mktsegment = 'MACHINERY'"), measured, A.dimension(spark, [("CC", True), ("LOC", False)], "code string, required boolean"))


@register("unresolved_issues", "SELECT DISTINCT user_id::VARCHAR AS file, 'unresolved-dependency' AS reason FROM events WHERE event_type = 'error' AND user_id % 3 = 0 AND event_id % 50 <> 0 UNION ALL SELECT NULL, 'unresolved-dependency' WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND event_id % 50 = 0)")
def unresolved_issues(spark, sf_dir):
    errors = A.table(spark, sf_dir, "events").filter("event_type = 'error'")
    diagnostics = errors.select(F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string")).alias("path"))
    subjects = A.table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("path")).distinct()
    return S.unresolved_issues(diagnostics, subjects)


@register("findings_by_file", "SELECT user_id::VARCHAR AS file, count(*) FILTER (event_type = 'error') AS violations, count(*) FILTER (event_type = 'signup') AS warnings FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def findings_by_file(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), "event_type")
    return S.by_file(events.filter("event_type = 'error'"), events.filter("event_type = 'signup'"))


@register("evidence_pairs", f"WITH {A.REVISIONS_SQL} SELECT n.entity_id, n.code, b.value AS before, n.value AS after FROM n LEFT JOIN b ON b.entity_id = n.entity_id AND b.code = n.code")
def evidence_pairs(spark, sf_dir):
    return S.paired_evidence(*A.revisions(spark, sf_dir))


@register("merged_findings", "SELECT event_type AS rule, user_id::VARCHAR AS entity_id, min(event_id) AS seq, bool_or(value > 95) AS blocking, array_to_string(list_sort(list(DISTINCT event_id % 4)), ',') AS evidence FROM events GROUP BY ALL")
def merged_findings(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_id").alias("seq"), (F.col("value") > 95).alias("blocking"), F.array(F.col("event_id") % 4).alias("evidence"))
    return S.merged_findings(rows).withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@register("moved_and_changed", "SELECT count(*) FILTER (doc_id % 7 = 0) AS left_out, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 3 = 0) AS eligible FROM documents")
def moved_and_changed(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    eligible = S.eligible(docs.filter("doc_id % 7 != 0"), docs.filter("doc_id % 3 = 0")).agg(F.count("*").alias("eligible"))
    return docs.agg(F.count_if(F.col("doc_id") % 7 == 0).alias("left_out")).crossJoin(F.broadcast(eligible))
