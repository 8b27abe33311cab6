"""Adapters: the star schema read as an entity hierarchy (package, class, method), revisions, trees and edges.

Each adapter comes with the SQL of the same table for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import rollup
from quarry.session import literal_rows

METHODS_SQL = """
m AS (
  SELECT c_nationkey AS package, c_custkey AS class, o_orderkey AS method, count(*) AS "NOPM", 1 + count(*) FILTER (l_returnflag = 'R') AS "CC",
         sum(l_quantity::BIGINT)::BIGINT AS "LOC", count(*) FILTER (l_linestatus = 'O') AS "CCM", count(DISTINCT l_suppkey) AS "CINT"
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
), c AS (
  SELECT package, class, count(*) AS "NOM", sum("CC")::BIGINT AS "WMC", sum("LOC")::BIGINT AS "CLOC", sum("CCM")::BIGINT AS "CCC" FROM m GROUP BY ALL
), x AS (
  SELECT class::VARCHAR AS entity_id, code, value FROM (UNPIVOT c ON "NOM", "WMC", "CLOC", "CCC" INTO NAME code VALUE value)
)
"""
REVISIONS_SQL = """
r AS (
  SELECT o_orderstatus AS rev, o_custkey || '/' || p_brand AS entity_id, count(*) AS "NOM", sum(l_quantity::BIGINT)::BIGINT AS "WMC"
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL
), rl AS (
  SELECT rev, entity_id, code, value::DOUBLE AS value FROM (UNPIVOT r ON "NOM", "WMC" INTO NAME code VALUE value)
), b AS (SELECT entity_id, code, value FROM rl WHERE rev = 'F'), n AS (SELECT entity_id, code, value FROM rl WHERE rev = 'O')
"""
TREE_SQL = "e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 2)"
PACKAGE_EDGES_SQL = """
pv AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity::BIGINT)::BIGINT AS volume
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
), pe AS (SELECT src, dst FROM pv WHERE volume * (SELECT count(*) FROM pv) > (SELECT sum(volume) FROM pv)::BIGINT)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package, class, method and method metrics. Line items are summed before they meet their orders."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("NOPM"), (1 + F.count_if(F.col("l_returnflag") == "R")).alias("CC"), F.sum(F.col("l_quantity").cast("long")).alias("LOC"),
        F.count_if(F.col("l_linestatus") == "O").alias("CCM"), F.count_distinct("l_suppkey").alias("CINT"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_nationkey").alias("package"), F.col("c_custkey").alias("class"), F.col("o_orderkey").alias("method"), "NOPM", "CC", "LOC", "CCM", "CINT")
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods(spark, sf_dir).groupBy("package", "class").agg(F.count("*").alias("NOM"), F.sum("CC").alias("WMC"), F.sum("LOC").alias("CLOC"), F.sum("CCM").alias("CCC"))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.long_form(classes(spark, sf_dir), "class", "class", "package", ["NOM", "WMC", "CLOC", "CCC"])


def both_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id with NOMb, WMCb, NOMn and WMCn: filled orders as the base, open ones as the current revision; null where an entity isn't in one.

    One pass: line items meet their orders and parts once, and each revision is a condition of the sums.
    """
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("base"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    base = F.col("base")
    sums = joined.groupBy("o_custkey", "p_brand").agg(
        F.count_if(base).alias("b"), F.sum(F.when(base, F.col("quantity"))).alias("WMCb"), F.count_if(~base).alias("n"), F.sum(F.when(~base, F.col("quantity"))).alias("WMCn")
    )
    known = lambda n: F.when(F.col(n) > 0, F.col(n).cast("double"))
    return sums.select(
        F.concat_ws("/", F.col("o_custkey").cast("string"), "p_brand").alias("entity_id"), known("b").alias("NOMb"), F.col("WMCb").cast("double").alias("WMCb"), known("n").alias("NOMn"), F.col("WMCn").cast("double").alias("WMCn")
    )


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, code, value, base_value, old_entity): current metric rows with what they were, null where an entity is new or gone."""
    pair = lambda c: F.struct(F.lit(c).alias("code"), F.col(f"{c}n").alias("value"), F.col(f"{c}b").alias("base_value"))
    rows = both_revisions(spark, sf_dir).select("entity_id", F.explode(F.array(pair("NOM"), pair("WMC"))).alias("m"))
    return rows.select("entity_id", "m.*", F.col("m.base_value").isNotNull().alias("old_entity"))


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(base, current) metric rows (entity_id, code, value): filled orders against open ones."""
    rows = compared(spark, sf_dir)
    return rows.select("entity_id", "code", F.col("base_value").alias("value")).filter("value is not null"), rows.select("entity_id", "code", "value").filter("value is not null")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parent and child of an inheritance tree over parts."""
    return table(spark, sf_dir, "part").filter("p_partkey >= 2").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))


def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): nations between which more than the average quantity of all pairs was traded."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"))
    orders, customers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    traded = joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("quantity").alias("volume"))
    total = traded.agg(F.sum("volume").alias("total"), F.count("*").alias("pairs"))  # one row
    return traded.crossJoin(F.broadcast(total)).filter(F.col("volume") * F.col("pairs") > F.col("total")).select("src", "dst")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals."""
    return literal_rows(spark, rows, schema)
