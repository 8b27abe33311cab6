"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass one hashes every text once (the digests go to a table in the shared folder) and sets two bits of a
blocked Bloom filter for each: both lie in one bitmap of 32,768 bits. Positions, 8 bytes each, are counted, and
those that two or more rows set form the filter. It has about ``BITS_A_ROW`` bits for each row and is broadcast;
where that would be more than ``most_bits``, digests are dealt by hash into slices that have a filter each, so the
broadcast stays bounded and the filter as sparse at any size. Pass two looks up both bits of every row: unless
both were set twice, the row's text is unique and the row passes straight through. Only the possibly repeated rows
shuffle, by digest, with partial aggregates first; their groups then meet the rows in a join in which hot groups
are broadcast. A fuller filter lets more rows shuffle but never loses a repeat, and unlike texts never share a
SHA-256 digest here.

Defined cases: a null text equals the empty text; of equal texts the row with the largest doc_id stays,
null doc_ids being the smallest; rows with equal text and equal doc_id all stay when that doc_id is the
largest (they are one document); if all doc_ids of a group are null, all its rows stay with keep_id null; an
empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, stored, text_of

#: Bits of one bitmap of bitmap_construct_agg.
BITMAP_BITS = 32768
#: Bits of the filter for a row, and of one filter at most: 128 MB are broadcast at once.
BITS_A_ROW, MOST_BITS = 16, 1 << 30


def bit_positions(digest: Column, bits: int) -> Column:
    """Two bit positions in [0, bits) of a digest, in one bitmap."""
    first = F.pmod(F.xxhash64(digest, F.lit(1)), F.lit(bits // BITMAP_BITS)) * BITMAP_BITS
    within = F.xxhash64(digest, F.lit(2))
    return F.array(*(first + F.pmod(F.shiftrightunsigned(within, by), F.lit(BITMAP_BITS)) for by in (0, 32)))


def repeated_bits(digests: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the bits that more than one row sets; at most bits / BITMAP_BITS rows of 4 KB."""
    position = F.explode(F.array_distinct("positions")).alias("position")
    twice = digests.select(position).groupBy("position").count().filter("count > 1")
    return twice.groupBy(F.expr(f"position div {BITMAP_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("position") % BITMAP_BITS).alias("bitmap"))


def maybe_repeated(digests: DataFrame, bits: int) -> DataFrame:
    """``digests`` with ``maybe``: whether both bits of the row are among the repeated ones."""
    found = digests.withColumn("bucket", F.expr(f"positions[0] div {BITMAP_BITS}")).join(F.broadcast(repeated_bits(digests)), "bucket", "left")

    def is_set(i: int) -> Column:
        bit = (F.col("positions")[i] % BITMAP_BITS).cast("int")
        byte = F.ascii(F.decode(F.substring("bitmap", F.expr(f"cast(positions[{i}] % {BITMAP_BITS} as int) div 8 + 1").cast("int"), F.lit(1)), "ISO-8859-1"))
        return F.getbit(byte, bit % 8) == 1

    return found.withColumn("maybe", F.coalesce(is_set(0) & is_set(1), F.lit(False))).drop("bucket", "bitmap")


def filter_size(rows: int, most_bits: int = MOST_BITS) -> tuple[int, int]:
    """(bits of a filter, slices) for so many rows."""
    wanted = max(1, rows) * BITS_A_ROW
    slices = -(-wanted // most_bits)
    return -(-wanted // slices // BITMAP_BITS) * BITMAP_BITS or BITMAP_BITS, slices


def decide(docs: DataFrame, bits: int | None = None, slices: int = 1, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. ``bits``: a multiple of 32,768; by default set from the number of rows, as ``slices`` then is."""
    total = docs.count()
    if bits is None:
        bits, slices = filter_size(total, most_bits)
    if bits % BITMAP_BITS or bits <= 0:
        raise ValueError(f"bits must be a positive multiple of {BITMAP_BITS}")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(docs), 256)).alias("sha"))
    digests = stored(hashed.withColumn("slice", F.pmod(F.xxhash64("sha"), F.lit(slices)).cast("int")), "digests", *(["slice"] if slices > 1 else []))
    digests = digests.withColumn("positions", bit_positions(F.col("sha"), bits))
    parts = [maybe_repeated(digests.filter(F.col("slice") == i) if slices > 1 else digests, bits) for i in range(slices)]
    tested = stored(reduce(DataFrame.unionByName, parts).select("doc_id", "sha", "maybe"), "tested")
    single = tested.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    rows = tested.filter("maybe").select("doc_id", "sha")
    groups = stored(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "repeated-texts")
    grouped = attach(rows, groups, "sha", "group_size", total)
    every = single.unionByName(grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"))
    return every.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
