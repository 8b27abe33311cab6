"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: the sources share ``share`` times all sizes by weight; no target passes ``most`` times its
source's size, and what that cuts off is shared anew by weight until none is above. That fixed point is
target = min(most * size, level * weight) for one level, found by a prefix sum over sources in the order
in which they reach their ceiling. Ranks and prefix sums of sources go by ranges, so that many sources are no hot task.

Sampling: every document of a source is expected target / source size times. The prefix sum of those
expectations within the source, plus one random offset of the source, is cut at the integers; a document
is taken once for each integer that its interval crosses, so never more than ``ceil(most)`` times. As the
expectation is the same for all documents of a source, the prefix sum is a position times a rate.
Positions follow size classes first, so that each class gets its share. They are computed in two levels:
a row number within blocks (source, size class, hash of doc_id, or of the text where that is null, modulo ``blocks``),
of which a hot source has many, and a prefix sum over the block counts, at most classes * blocks rows for a source.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of
size 0 take part and add nothing; a source without words has target 0 and rate 0; rows with the same
doc_id are ordered by size and text hash and are otherwise interchangeable (in ``mix`` those alike in doc_id, source
and text share the larger of their counts); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, running, sized, stored, text_of

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Four classes to each power of two, in integers only."""
    bits = F.length(F.bin(size)).cast("long")
    return bits * 8 + F.expr(f"(size * 8) div shiftleft(1L, cast(length(bin(size)) as int))")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size). One row a source; sources are counted, not documents."""
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = running(sizes.select("source", "source_size"), by_name, {"rank": F.lit(1)}, "source-ranks")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ceiling = F.col("source_size") * F.lit(most)
    weighed = ranked.select("source", "source_size", weight.alias("weight"), ceiling.alias("ceiling"), (ceiling / weight).alias("ratio"))
    by_ceiling = [F.col("ratio"), *by_name]
    filled = running(weighed, by_ceiling, {"spent": F.col("ceiling"), "passed": F.col("weight")}, "source-levels")
    every = weighed.agg((F.sum("source_size") * F.lit(share)).alias("total"), F.sum("weight").alias("weights"))  # one row
    level = (F.col("total") - F.col("spent")) / (F.col("weights") - F.col("passed"))
    levelled = filled.crossJoin(F.broadcast(every)).withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("ceiling"))
    first = levelled.filter("not full").agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(by_ceiling)), "level"))["level"].alias("found"))  # one row
    return levelled.crossJoin(F.broadcast(first)).select("source", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("found") * F.col("weight")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source and seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**32))


def block_of(docs: DataFrame, blocks: int) -> Column:
    """A block from the hash of doc_id, whatever ids there are, or of the text where there is none."""
    digits = F.substring(F.md5(F.coalesce(docs["doc_id"].cast("long").cast("string"), text_of(docs))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % blocks


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, blocks: int = 256) -> DataFrame:
    """doc_id, source, size, tie (hash of the text), source_size, target and copies (how often the document is taken) for every row."""
    measured = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(text_of(docs)).alias("size"), F.xxhash64("text").alias("tie"), block_of(docs, blocks).alias("block"))
        .withColumn("class", size_class(F.col("size"))),
        "mixing",
    )
    counted = measured.groupBy("source", "class", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counted = stored(counted, "mixing-blocks")
    per_source = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    per_source = stored(per_source, "mixing-targets")
    before = Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("source", "class", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = starts.join(sized(per_source, 256), starts["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    within = Window.partitionBy("source", "class", "block").orderBy("doc_id", "size", "tie")
    rows = measured.withColumn("nth", F.row_number().over(within))
    on = rows["source"].eqNullSafe(placed["source"]) & (rows["class"] == placed["class"]) & (rows["block"] == placed["block"])
    end = F.col("start") + F.col("nth")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shift = offset(rows["source"], seed)
    return rows.join(placed, on).select(
        "doc_id", rows["source"], "size", "tie", "source_size", "target",
        (F.floor(shift + end * rate) - F.floor(shift + (end - 1) * rate)).alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    taken = copies(docs, **options).filter("copies > 0").groupBy("doc_id", "source", "tie").agg(F.max("copies").alias("__copies"))
    alike = docs["doc_id"].eqNullSafe(taken["doc_id"]) & docs["source"].eqNullSafe(taken["source"]) & (F.xxhash64(docs["text"]) == taken["tie"])
    joined = docs.join(taken, alike).select(docs["*"], "__copies")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__copies", "__copy")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), c AS (
  SELECT *, length(bin(size)) * 8 + (size * 8) // (1::BIGINT << length(bin(size))::BIGINT) AS class, ('0x' || md5(coalesce(doc_id::VARCHAR, text, ''))[1:8])::BIGINT % 256 AS block FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS ceiling, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), f AS (
  SELECT *, (total - coalesce(sum(ceiling) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lvl FROM w
  WINDOW o AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN lvl * weight >= ceiling THEN ceiling ELSE
    (SELECT arg_min(lvl, (g.ceiling / g.weight, g.source)) FROM f g WHERE g.lvl * g.weight < g.ceiling) * weight END AS target FROM f
), p AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY c.source ORDER BY c.class, c.block, c.doc_id) AS k,
         ('0x' || md5('7:' || coalesce(c.source, chr(0)))[1:8])::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (floor(shift + k * rate) - floor(shift + (k - 1) * rate)))::BIGINT AS taken FROM p
"""
