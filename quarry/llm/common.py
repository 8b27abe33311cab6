"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than these (space, tab, line feed, vertical tab, form feed, carriage return).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch, so that very long texts don't add up to a large one.
BATCH_ROWS = 256
#: A key is hot from this share of the rows on; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 5000
#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is made only where none is configured, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)  # of this process alone, gone with it
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables written by ``stored`` and not yet removed, oldest first.
STORED: list[str] = []


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it survives lost executors and is computed once.

    ``by``: columns by whose values the table is divided into folders, so that readers of one value read no other.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Removes the tables written after the first ``since`` ones, but for those in ``keep``; what reads them must be done."""
    for path in [p for p in STORED[since:] if p not in keep]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        STORED.remove(path)


def map_batches(docs: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``function`` over Arrow batches of few rows, whatever the session's batch size is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield function(batch.slice(at, BATCH_ROWS))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Keep what crosses to Python at once small: rows may hold texts of any length."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 4 * BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(4 * BATCH_ROWS))


def chosen_ids(rows: DataFrame, by: str, per: int) -> list[tuple]:
    """(doc_id, value): for each value of ``by`` (nulls left out) the ``per`` doc_ids with the smallest hash, each once.

    Only rows whose hash lies below a limit are ranked, set by the value's count so that about twice as many pass;
    where repeated ids leave too few, the limit is raised for that value. So what is ranked grows neither with the
    rows nor with the tasks. The result has at most ``per`` entries for each value.
    """
    spark = rows.sparkSession
    hashed = rows.select("doc_id", F.col(by).alias("__value"), F.xxhash64("doc_id").alias("__hash")).filter("doc_id is not null and __value is not null")
    share = {r[0]: (2 * per + 64) / r[1] for r in hashed.groupBy("__value").count().collect()}
    kind = dict(hashed.dtypes)["__value"]
    found: list[tuple] = []
    while share:
        limits = spark.createDataFrame([(v, min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63))) for v, s in share.items()], f"__value {kind}, __limit long")
        few = hashed.join(F.broadcast(limits) if len(share) <= 100_000 else limits, "__value").filter("__hash <= __limit").select("__value", "__hash", "doc_id").distinct()
        nth = F.row_number().over(Window.partitionBy("__value").orderBy("__hash", "doc_id"))
        got: dict = {v: [] for v in share}
        for r in few.withColumn("nth", nth).filter(F.col("nth") <= per).collect():
            got[r["__value"]].append(r.doc_id)
        found += [(i, v) for v, ids in got.items() if len(ids) >= per or share[v] >= 1 for i in ids]
        share = {v: 4 * s for v, s in share.items() if len(got[v]) < per and s < 1}
    return sorted(found, key=lambda f: (str(f[1]), f[0]))


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` to be broadcast if its rows, ``row_bytes`` each at most, fit into BROADCAST_BYTES; else it is joined by shuffling."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with sums over all rows before each one in ``order``, which no two rows may share.

    Rows are dealt by ranges of the order and stored; the ranges' sums, a few rows, give where each range
    starts, and a window within the range gives the rest. No task holds all rows.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__range"), *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()))
    return placed.join(F.broadcast(starts), "__range").select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join ``groups`` (unique in ``key``, with its row count in ``size``) to ``rows`` without a hot task.

    Groups with at least 1/HOT_SHARE of the ``total`` rows are at most HOT_SHARE many, so they are
    broadcast; the rows of all others are shuffled, no more than total/HOT_SHARE for a key.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot = groups.filter(F.col(size) >= least)
    cold = groups.filter(F.col(size) < least)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))


def signature(df: DataFrame) -> tuple:
    """Row count and two sums of row hashes: equal for equal sets of rows, and for no others but by chance (2**-95)."""
    h = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(F.xxhash64(F.lit(1), *df.columns), F.lit(1 << 31)))).first())


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of ``links(a, b)``: (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds over tables in the shared folder; each round maps
    every node's larger (then smaller) neighbours to its smallest neighbour, and stops when a round changes nothing.
    Self links and nulls are left out, so a node without other links has no row.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, edges = signature(edges), stored(small.filter("a <> b").distinct(), name)
        if signature(edges) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
