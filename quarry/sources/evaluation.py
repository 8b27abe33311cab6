"""Inputs of rule evaluation: labelled cases, other tools' reports, and a synthetic corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "id string, project string, path string, split string, grp string"
LABEL_SCHEMA = "id string, rule string, expected boolean"
REPORT_SCHEMA = "files array<struct<filename: string, violations: array<struct<rule: string, beginline: long, priority: int>>>>, processingErrors array<string>, configurationErrors array<string>"


def cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).option("multiLine", True).json(path)


def tool_findings(spark: SparkSession, path: str) -> DataFrame:
    """(report, status, filename, rule, line): findings of external reports; a report with errors or without files is one ``failed`` row."""
    raw = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path).withColumn("report", F.col("_metadata.file_name"))
    sound = F.col("files").isNotNull() & (F.coalesce(F.size("processingErrors"), F.lit(0)) <= 0) & (F.coalesce(F.size("configurationErrors"), F.lit(0)) <= 0)
    failed = raw.filter(~sound).select("report", F.lit("failed").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("filename", "string"), ("rule", "string"), ("line", "long"))))
    files = raw.filter(sound).select("report", F.explode("files").alias("file"))
    found = files.select("report", F.lit("ok").alias("status"), F.col("file.filename").alias("filename"), F.explode("file.violations").alias("v")).select("report", "status", "filename", F.col("v.rule").alias("rule"), F.col("v.beginline").alias("line"))
    return found.unionByName(failed)


def leakage(case_rows: DataFrame, key: str) -> DataFrame:
    """Keys that appear in more than one split."""
    return case_rows.groupBy(key).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def corpus(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(path, content) of ``n`` generated Java files; the same seed gives the same files."""
    k = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(most))
    branches = F.array_join(F.transform(F.sequence(F.lit(0), k(1, 6)), lambda i: F.concat(F.lit("        if (a > "), i.cast("string"), F.lit(") { total += b; }\n"))), "")
    package = F.concat(F.lit("gen.p"), k(2, 20).cast("string"))
    text = F.concat(F.lit("package "), package, F.lit(";\npublic class C"), F.col("id").cast("string"), F.lit(" {\n    private int total;\n    public int run(int a, int b) {\n"), branches, F.lit("        return total;\n    }\n}\n"))
    path = F.concat(F.replace(package, F.lit("."), F.lit("/")), F.lit("/C"), F.col("id").cast("string"), F.lit(".java"))
    return spark.range(n).select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))
