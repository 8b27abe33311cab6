"""What a check may look at and what it missed: roles, contexts, local changes and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.windows import first_match

#: Default roles by path (the first that matches the whole path), and names of build descriptors.
ROLES = [("GENERATED", "(.*/)?generated/.*"), ("GENERATED", "(.*/)?gen/.*"), ("TEST", "(.*/)?src/test/java/.*"), ("TEST", "(.*/)?src/integrationTest/java/.*"), ("PRODUCTION", "(.*/)?src/main/java/.*")]
BUILD_NAMES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "libs.versions.toml")


def role(path: Column) -> Column:
    return first_match(path, ROLES, "UNKNOWN")


def is_java(path: Column) -> Column:
    return F.coalesce(path.endswith(".java"), F.lit(False))


def qualified_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.java$", ""), F.lit("/"), F.lit("."))


def is_build_descriptor(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.isin(*BUILD_NAMES) | name.endswith(".lockfile") | name.endswith(".gradle.versions.toml")


def in_context(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` (path) with ``inside``: at or below a declared root (root); no roots at all means everywhere.

    Every path is turned into its own ancestors, so roots are found by equality and not by comparing all pairs.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = paths.select("path", F.explode(above).alias("root")).join(roots.select(F.regexp_replace("root", "/+$", "").alias("root")).distinct(), "root", "left_semi").select("path").distinct()
    some = roots.agg((F.count("*") > 0).alias("some"))  # one row
    return paths.join(hits.withColumn("hit", F.lit(True)), "path", "left").crossJoin(F.broadcast(some)).select(*paths.columns, (F.coalesce("hit", F.lit(False)) | ~F.col("some")).alias("inside"))


def local_changes(changes: DataFrame, head: DataFrame, after: DataFrame) -> DataFrame:
    """Path changes of a working state: those given, A and M from the manifests, D for what is gone.

    ``changes`` (status, old_path, new_path), ``head`` and ``after`` (path, sha256). Additions and deletions that
    are an end of a rename go, and each (status, end) is kept once.
    """
    both = head.withColumnRenamed("sha256", "old").join(after.withColumnRenamed("sha256", "new"), "path", "full")
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    found = both.select(status.alias("status"), F.when(F.col("old").isNotNull(), F.col("path")).alias("old_path"), F.when(F.col("new").isNotNull(), F.col("path")).alias("new_path")).filter("status is not null")
    everything = changes.select("status", "old_path", "new_path").unionByName(found)
    ends = everything.filter("status = 'R'").select(F.explode(F.array("old_path", "new_path")).alias("end")).distinct()
    end = F.when(F.col("status") == "D", F.col("old_path")).otherwise(F.col("new_path"))
    rows = everything.withColumn("end", end)
    single = rows.filter("status in ('A', 'D')").join(ends, "end", "left_anti").unionByName(rows.filter("status not in ('A', 'D')"))
    return single.groupBy("status", "end").agg(F.min("old_path").alias("old_path"), F.min("new_path").alias("new_path")).drop("end")


def eligible(entities: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Entities (path) in the changed set; without one, all."""
    return entities if changed is None else entities.join(changed.select("path").distinct(), "path", "left_semi")


def blocking(flag: Column, disposition: Column, lifecycle: Column, status: Column, advisory: bool = False) -> Column:
    """Whether a finding blocks: asked for, active, of an eligible lifecycle and a complete match; never in advisory mode."""
    if advisory:
        return F.lit(False)
    return flag & (disposition == "ACTIVE") & lifecycle.isin("NEW_ENTITY", "INTRODUCED", "WORSENED") & (status == "MATCH")


def unresolved_issues(diagnostics: DataFrame, subjects: DataFrame) -> DataFrame:
    """(file, reason): files among ``subjects`` (path) with a resolution diagnostic, and one row without a file if any has no path."""
    named = diagnostics.filter("path is not null").select("path").distinct().join(subjects, "path", "left_semi").select(F.col("path").alias("file"))
    unnamed = diagnostics.filter("path is null").limit(1).select(F.lit(None).cast("string").alias("file"))  # one issue stands for all
    return named.unionByName(unnamed).withColumn("reason", F.lit("unresolved-dependency"))


def completeness(subjects: DataFrame, parsed: DataFrame, unsupported: DataFrame, measured: DataFrame, required: DataFrame) -> DataFrame:
    """(file, code, reason, required): subjects that weren't parsed, hold unsupported declarations, or lack a metric.

    ``subjects`` (path), ``parsed`` (path), ``unsupported`` (path), ``measured`` (path, code), ``required`` (code, required).
    """
    errors = subjects.join(parsed, "path", "left_anti").select(F.col("path").alias("file"), F.lit(None).cast("string").alias("code"), F.lit("current-parse-error").alias("reason"), F.lit(True).alias("required"))
    odd = unsupported.select("path").distinct().join(subjects, "path", "left_semi").select(F.col("path").alias("file"), F.lit(None).cast("string").alias("code"), F.lit("unsupported-declaration").alias("reason"), F.lit(True).alias("required"))
    wanted = subjects.join(parsed, "path", "left_semi").crossJoin(F.broadcast(required))  # the metrics of a policy, some tens
    reason = F.when(F.col("required"), "metric-unavailable-local").otherwise("optional-unavailable")
    gaps = wanted.join(measured, ["path", "code"], "left_anti").select(F.col("path").alias("file"), "code", reason.alias("reason"), "required")
    return errors.unionByName(odd).unionByName(gaps)


def issue_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.col("required").desc(), F.col("file").asc_nulls_first(), F.col("code").asc_nulls_first(), "reason")


def by_file(violations: DataFrame, warnings: DataFrame) -> DataFrame:
    """(file, violations, warnings): counts over the union of the files of both."""
    count = lambda df, name: df.groupBy("file").agg(F.count("*").alias(name))
    return count(violations, "violations").join(count(warnings, "warnings"), "file", "full").na.fill(0, ["violations", "warnings"])


def paired_evidence(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity_id, code, before, after): what each current measure was before, null if it wasn't measured."""
    return after.withColumnRenamed("value", "after").join(before.withColumnRenamed("value", "before"), ["entity_id", "code"], "left").select("entity_id", "code", "before", "after")


def merged_findings(findings: DataFrame) -> DataFrame:
    """One row for each (rule, entity_id): the first by seq, blocking if any is, with the evidence of all."""
    return findings.groupBy("rule", "entity_id").agg(F.min_by("seq", "seq").alias("seq"), F.bool_or("blocking").alias("blocking"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
