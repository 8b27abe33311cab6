"""Line deduplication across documents.

Every text is split into lines; a line's key is the line stripped of ASCII white space and lower-cased in
A-Z. Keys of at least ``min_chars`` code points are hashed (128 bits) and the documents of each hash are
counted; where ``min_docs`` or more hold it, its lines stay in the smallest doc_id only. What is left is
put together again by position.

Only hashes, doc_ids and positions are exchanged for the decision, pre-aggregated by hash; the hash counts
meet the lines in a join with hot hashes broadcast, so a line that a third of all documents hold is no hot
task. Texts move once, to meet their document's list of dropped positions.

Defined cases: a null or empty text is one empty line; documents are told apart by doc_id and text, so rows
that repeat both lose the same lines, and one doc_id counts as one document; rows with a null doc_id neither
count nor lose lines; line ends other than \\n are ordinary characters (stripped at the ends of a key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, SPACES, UPPER, attach, stored, text_of

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, mark, gone): positions, from 0, of the lines that each document loses; no row if none."""
    texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64(text_of(docs)).alias("mark"), F.split(text_of(docs), "\n", -1).alias("lines"))
    lines = texts.select("doc_id", "mark", F.posexplode("lines").alias("at", "line")).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    held = stored(lines.select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "mark", "at"), "lines")
    counted = held.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first < last")
    if min_docs > 2:  # the least and the largest doc_id no longer tell; count exactly
        several = held.join(counted.select("hash"), "hash", "left_semi").select("hash", "doc_id").distinct().groupBy("hash").count().filter(F.col("count") >= min_docs)
        counted = counted.join(several.select("hash"), "hash", "left_semi")
    groups = stored(counted.select("hash", "first", "n"), "repeated")
    found = attach(held, groups, "hash", "n", held.count()).filter("first is not null and doc_id != first")
    return found.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone"))


def kept_lines(docs: DataFrame, **options) -> DataFrame:
    """Columns of ``docs`` plus __lines (count), __gone (count dropped) and __kept (the remaining text)."""
    gone = dropped_positions(docs, **options).withColumnsRenamed({"doc_id": "__doc", "mark": "__mark", "gone": "__at"})
    named = docs.filter("doc_id is not null").withColumn("__own", F.xxhash64(text_of(docs)))
    joined = named.join(gone, (F.col("doc_id") == F.col("__doc")) & (F.col("__own") == F.col("__mark")), "left")
    # rows without a doc_id lose nothing; kept out of the join, they are no hot key
    joined = joined.unionByName(docs.filter("doc_id is null"), allowMissingColumns=True)
    lines = F.split(text_of(joined), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__at"))
    # as an element of an array the lines are bound to a variable once, where a lambda would split the text for each line
    left = F.transform(F.array(lines), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))[0]
    return (
        joined.withColumn("__lines", F.size(lines).cast("long"))
        .withColumn("__gone", F.coalesce(F.size("__at"), F.lit(0)).cast("long"))
        .withColumn("__kept", F.when(F.col("__at").isNull(), text_of(joined)).otherwise(left))
        .drop("__own", "__doc", "__mark", "__at")
    )


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and ``n_chars``, if there, counted anew."""
    kept = kept_lines(docs, **options)
    made = {"text": F.col("__kept"), "n_chars": F.char_length("__kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return kept.select(*(made[c].alias(c) if c in made else F.col(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    kept = kept_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return kept.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(g.first <> k.doc_id, false) AS gone FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
