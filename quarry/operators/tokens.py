"""Token, line and nesting measures over texts and markup, and evaluation of rule agreement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import formulas

#: Words that play the operators; every other word is an operand.
OPERATORS = ("the", "of", "and", "in", "to", "de", "la", "le", "der", "die", "que", "en")
TOKEN = r"[^ \n.,]+"


def text_counts(docs: DataFrame) -> DataFrame:
    """n1, n2, N1, N2 as ``halstead_counts`` has them, of the words of each text: from arrays of the row itself, without a shuffle."""
    def counted(words: Column, ops: Column) -> Column:
        n1, big_n1 = F.size(F.array_distinct(ops)), F.size(ops)
        return F.struct(*(c.cast("long").alias(n) for n, c in (("n1", n1), ("n2", F.size(F.array_distinct(words)) - n1), ("big_n1", big_n1), ("big_n2", F.size(words) - big_n1))))

    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of a value that is computed once: columns that are used twice are otherwise inlined and computed anew."""
        return F.transform(F.array(value), then)[0]

    found = bound(F.regexp_extract_all("text", F.lit(TOKEN), 0), lambda words: bound(F.filter(words, lambda w: w.isin(*OPERATORS)), lambda ops: counted(words, ops)))
    counts = docs.select("doc_id", found.alias("c")).select("doc_id", "c.*")
    return counts.filter("n1 > 0 and n2 > 0")


def halstead_counts(token_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """n1, n2 (distinct operators, operands) and N1, N2 (all of them); rows with a zero are not measured, so they go.

    Tokens are first counted by word, which bounds what a distinct count has to hold.
    """
    by_word = token_rows.groupBy(key, "token", "is_operator").agg(F.count("*").alias("n"))
    op = F.col("is_operator")
    counts = by_word.groupBy(key).agg(
        F.count_if(op).alias("n1"), F.count_if(~op).alias("n2"), F.coalesce(F.sum(F.when(op, F.col("n"))), F.lit(0)).alias("big_n1"), F.coalesce(F.sum(F.when(~op, F.col("n"))), F.lit(0)).alias("big_n2")
    )
    return counts.filter("n1 > 0 and n2 > 0 and big_n1 > 0 and big_n2 > 0")


def halstead(counts: DataFrame) -> DataFrame:
    measures = formulas.halstead(F.col("n1"), F.col("n2"), F.col("big_n1"), F.col("big_n2"))
    return counts.select("*", *(v.alias(n) for n, v in measures.items()))


def line_counts(docs: DataFrame) -> DataFrame:
    """Lines, non-blank lines and decision-like marks of each text, without exploding it."""
    lines = F.split("text", "\n")
    return docs.select(
        "doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.length(F.trim(x)) > 0)).cast("long").alias("code_lines"),
        (1 + F.regexp_count("text", F.lit(r"[,!?]"))).cast("long").alias("complexity"),
    )


def nesting(pages: DataFrame) -> DataFrame:
    """Deepest and summed nesting of the block tags of each page: +1 for an opening tag, -1 for a closing one."""
    marks = F.regexp_extract_all("html", F.lit("</?(?:html|body|nav|ul|li|div|article|p|h1|footer|head)[ >]"), 0)
    events = pages.select("page_id", F.posexplode(marks).alias("pos", "tag")).withColumn("step", F.when(F.col("tag").startswith("</"), -1).otherwise(1))
    depth = F.sum("step").over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    opened = events.withColumn("depth", depth).filter("step = 1")
    return opened.groupBy("page_id").agg(F.max("depth").alias("max_nesting"), F.sum("depth").alias("cognitive"), F.count("*").alias("elements"))


def agreement(cases: DataFrame) -> DataFrame:
    """Rate of groups in which every case's expectation equals the rule's answer: (rule, grp, expected, found) rows; null expectations are uncertain."""
    sure = cases.filter("expected is not null").groupBy("rule", "grp").agg(F.bool_and(F.col("expected") == F.col("found")).alias("agrees"))
    rates = sure.groupBy("rule").agg(F.count_if("agrees").alias("agreed"), F.count("*").alias("groups"))
    unsure = cases.filter("expected is null").groupBy("rule").agg(F.count("*").alias("uncertain"))
    return rates.join(unsure, "rule", "left").select("rule", "agreed", "groups", F.round(F.try_divide(F.col("agreed").cast("double"), "groups"), 4).alias("rate"), F.coalesce("uncertain", F.lit(0)).alias("uncertain"))
