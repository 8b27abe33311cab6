"""Window-like operators: caps, first and last wins, first matching rule, extremes. Orders end in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import kept


def _first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _first(df, keys, order)


def dedupe_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _first(df, keys, [c.desc() for c in order])


def capped(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each partition, the first ones."""
    return _first(df, keys, order, cap)


def omitted(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """How many rows capped() leaves out of each partition that has more."""
    return df.groupBy(*keys).agg((F.count("*") - cap).alias("omitted")).filter("omitted > 0")


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first rule whose regular expression matches the whole value."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        found = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return F.coalesce(found, F.lit(otherwise))


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place, from 1, of each row in a total order, without putting all rows into one task.

    Rows are dealt by ranges of the order and stored; the sizes of the ranges, a few rows, say where each begins.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__size"))
    begins = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__begin"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__nth", within).join(F.broadcast(begins), "__range").select(*df.columns, (F.col("__begin") + F.col("__nth")).alias(name))


def rule_match(rows: DataFrame, rules: DataFrame, on: list[str], extra: Column, order: str) -> DataFrame:
    """The first rule (by ``order``) with equal keys and ``extra`` true for each row; rules are few and broadcast-sized by AQE."""
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    return _first(rows.join(rules, on).filter(extra), ["__row"], [F.col(order)]).drop("__row")
