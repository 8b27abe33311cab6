"""Queries: token measures over documents, nesting over pages, and evaluation against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.value import wrap32
from quarry.operators import tokens as T
from quarry.plans import adapters as A
from quarry.plans.catalogue import register

_WORDS = ", ".join(f"'{w}'" for w in T.OPERATORS)
_TOKENS = f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n.,]+')) AS token FROM documents), o AS (SELECT *, token IN ({_WORDS}) AS op FROM w)"
_COUNTS = f"""{_TOKENS}, n AS (SELECT doc_id, count(DISTINCT token) FILTER (op) AS n1, count(DISTINCT token) FILTER (NOT op) AS n2, count(*) FILTER (op) AS big_n1, count(*) FILTER (NOT op) AS big_n2 FROM o GROUP BY 1),
h AS (SELECT * FROM n WHERE n1 > 0 AND n2 > 0 AND big_n1 > 0 AND big_n2 > 0)"""


def _counts(spark, sf_dir):
    return T.text_counts(A.table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("halstead_tokens", f"{_COUNTS} SELECT * FROM h")
def halstead_tokens(spark, sf_dir):
    return _counts(spark, sf_dir)


@register("halstead_metrics", f"""{_COUNTS} SELECT doc_id, round((big_n1 + big_n2) * (ln(n1 + n2) / ln(2.0)), 4) AS volume, round((n1 / 2.0) * (big_n2::DOUBLE / n2), 4) AS difficulty, round((2.0 / n1) * (n2::DOUBLE / big_n2), 6) AS length FROM h""")
def halstead_metrics(spark, sf_dir):
    m = T.halstead(_counts(spark, sf_dir))
    return m.select("doc_id", F.round("volume", 4).alias("volume"), F.round("difficulty", 4).alias("difficulty"), F.round("length", 6).alias("length"))


_WRAP = "CASE WHEN {x} >= 2147483648 THEN {x} - 4294967296 ELSE {x} END"


@register("halstead_effort_wrap", f"""{_COUNTS}, a AS (SELECT *, (n1 * big_n2) % 4294967296 AS p FROM h), b AS (SELECT *, ((({_WRAP.format(x='p')}) * (big_n1 + big_n2)) % 4294967296 + 4294967296) % 4294967296 AS q FROM a)
SELECT doc_id, ({_WRAP.format(x='q')})::BIGINT AS numerator, round((({_WRAP.format(x='q')})::DOUBLE * ln(n1 + n2)) / (2 * n2), 3) AS effort FROM b""")
def halstead_effort_wrap(spark, sf_dir):
    m = T.halstead(_counts(spark, sf_dir))
    numerator = wrap32(wrap32(F.col("n1") * F.col("big_n2")) * (F.col("big_n1") + F.col("big_n2")))
    return m.select("doc_id", numerator.alias("numerator"), F.round("effort", 3).alias("effort"))


@register("loc_lines", r"SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) AS code_lines, 1 + len(regexp_extract_all(text, '[,!?]')) AS complexity FROM documents")
def loc_lines(spark, sf_dir):
    return T.line_counts(A.table(spark, sf_dir, "documents").select("doc_id", "text"))


_NEST = r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '</?(?:html|body|nav|ul|li|div|article|p|h1|footer|head)[ >]')) AS tag, generate_subscripts(regexp_extract_all(html, '</?(?:html|body|nav|ul|li|div|article|p|h1|footer|head)[ >]'), 1) AS pos FROM pages),
d AS (SELECT page_id, tag, sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM e)"""


@register("cognitive_nesting", f"{_NEST} SELECT page_id, sum(depth)::BIGINT AS cognitive, count(*) AS elements FROM d WHERE tag NOT LIKE '</%' GROUP BY 1")
def cognitive_nesting(spark, sf_dir):
    return T.nesting(A.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "cognitive", "elements")


@register("max_nesting", f"{_NEST} SELECT page_id, max(depth)::BIGINT AS max_nesting FROM d WHERE tag NOT LIKE '</%' GROUP BY 1")
def max_nesting(spark, sf_dir):
    return T.nesting(A.table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "max_nesting")


_CASES = "c AS (SELECT 'long' AS rule, source AS grp, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE quality = 1 END AS expected, n_chars > 100 AS found FROM documents d JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'lang', lang, quality = 1, lang <> 'es' FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


@register("agreement_rate", f"WITH {_CASES}, g AS (SELECT rule, grp, bool_and(expected = found) AS agrees FROM c WHERE expected IS NOT NULL GROUP BY ALL) SELECT rule, count(*) FILTER (agrees) AS agreed, count(*) AS groups, round((count(*) FILTER (agrees))::DOUBLE / count(*), 4) AS rate, (SELECT count(*) FROM c WHERE c.rule = g.rule AND expected IS NULL) AS uncertain FROM g GROUP BY rule")
def agreement_rate(spark, sf_dir):
    cases = A.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(A.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    good = F.col("quality") == 1
    long = cases.select(F.lit("long").alias("rule"), F.col("source").alias("grp"), F.when(F.col("doc_id") % 9 != 0, good).alias("expected"), (F.col("n_chars") > 100).alias("found"))
    return T.agreement(long.unionByName(cases.select(F.lit("lang").alias("rule"), F.col("lang").alias("grp"), good.alias("expected"), (F.col("lang") != "es").alias("found"))))


@register("dedupe_problems", "SELECT sha256(text) AS problem, count(*) AS instances, array_to_string(list_sort(list(DISTINCT source)), ',') AS cases FROM documents GROUP BY 1")
def dedupe_problems(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("problem"), "source")
    return rows.groupBy("problem").agg(F.count("*").alias("instances"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("cases"))


@register("split_leakage", "SELECT sha256(text) AS content, count(DISTINCT doc_id % 3 = 0) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3 = 0) > 1")
def split_leakage(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), (F.col("doc_id") % 3 == 0).alias("held"))
    return rows.groupBy("content").agg(F.count_distinct("held").alias("splits"), F.count("*").alias("n")).filter("splits > 1")
