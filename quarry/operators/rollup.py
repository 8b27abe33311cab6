"""Roll-ups of metric rows: sums that treat undefined values three ways, z-scores, kinds, coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.value import truncated_ratio


def sum_or_absent(value: Column) -> Column:
    """Null (no row) where no value is defined."""
    return F.sum(value)


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("long"))


def sum_poisoned(value: Column, undefined: Column) -> Column:
    """Null as soon as one value is undefined; 0 for none at all."""
    return F.when(~F.coalesce(F.bool_or(undefined), F.lit(False)), F.coalesce(F.sum(value), F.lit(0).cast("long")))


def z_score(df: DataFrame, value: str, integral: bool) -> DataFrame:
    """One row: average (truncated for integral values), deviation, maximum and score = (max - avg) / deviation, 0 for deviation 0.

    Two passes: the deviation is taken around the truncated average, which a one-pass variance can't give.
    The average is one row, so it is joined by broadcast.
    """
    mean = truncated_ratio(F.sum(value), F.count(value)) if integral else F.try_divide(F.sum(value), F.count(value))
    average = df.agg(mean.alias("average"), F.max(value).alias("largest"))
    square = F.pow(F.col(value).cast("double") - F.col("average"), 2)
    spread = df.select(value).crossJoin(F.broadcast(average)).groupBy("average", "largest").agg(F.sqrt(F.try_divide(F.sum(square), F.count(value))).alias("deviation"))
    score = F.when(F.col("deviation") == 0, 0.0).otherwise((F.col("largest") - F.col("average")) / F.col("deviation"))
    return spread.select("average", "deviation", "largest", score.alias("score"))


def z_scores(df: DataFrame, values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """One row with the score of each of ``values`` (column, integral), as ``z_score`` has it; 0 where no value is defined.

    All of them take two passes over ``df`` together: sums and maxima, then squares around the averages.
    """
    firsts = [c for n, (v, integral) in values.items() for c in ((truncated_ratio(F.sum(v), F.count(v)) if integral else F.try_divide(F.sum(v), F.count(v))).alias(f"{n}_average"), F.max(v).alias(f"{n}_largest"))]
    averages = df.agg(*firsts)
    squares = [F.sqrt(F.try_divide(F.sum(F.pow(v.cast("double") - F.col(f"{n}_average"), 2)), F.count(v))).alias(n) for n, (v, _) in values.items()]
    names = averages.columns
    spread = df.crossJoin(F.broadcast(averages)).groupBy(*names).agg(*squares)
    score = lambda n: F.when(F.col(n) == 0, 0.0).otherwise((F.col(f"{n}_largest") - F.col(f"{n}_average")) / F.col(n))
    found = spread.select(*(score(n).alias(n) for n in values))
    return found.agg(*(F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in values))


#: Methods of a class whose pairs are counted within its row; a larger class's pairs are found by joins.
LARGE_CLASS = 400


def tight_cohesion(used: DataFrame, large: int = LARGE_CLASS) -> DataFrame:
    """class, methods, connected and tcc from distinct (class, method, field): connected pairs of methods over all pairs.

    A class's methods are gathered as arrays of fields and compared within the row; only classes with more than
    ``large`` methods join their uses by field.
    """
    by_method = used.groupBy("class", "method").agg(F.collect_list("field").alias("fields"))
    by_class = by_method.groupBy("class").agg(F.count("*").alias("methods"), F.slice(F.collect_list("fields"), 1, large + 1).alias("sets"))
    later = lambda i: F.slice("sets", i + 2, F.lit(large + 1))
    met = F.aggregate("sets", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n")), lambda acc, own: F.struct((acc["i"] + 1).alias("i"), (acc["n"] + F.size(F.filter(later(acc["i"]), lambda o: F.arrays_overlap(o, own)))).alias("n")))["n"]
    small = by_class.filter(F.col("methods") <= large).select("class", "methods", met.alias("connected"))
    big = by_class.filter(F.col("methods") > large).select("class", "methods")
    uses = used.join(big.select("class"), "class", "left_semi")
    a, b = (uses.select("class", "field", F.col("method").alias(s)) for s in "ab")
    pairs = a.join(b, ["class", "field"]).filter("a < b").select("class", "a", "b").distinct().groupBy("class").agg(F.count("*").alias("connected"))
    counted = small.unionByName(big.join(pairs, "class", "left").select("class", "methods", F.coalesce("connected", F.lit(0)).alias("connected")))
    return counted.withColumn("tcc", F.when(F.col("methods") < 2, 0.0).otherwise(F.col("connected").cast("double") / (F.col("methods") * (F.col("methods") - 1) / 2)))


def coupling(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """package, ce, ca, instability from dependency edges (src, dst) between different packages."""
    foreign = edges.filter("src != dst").distinct()
    ce = foreign.groupBy(F.col("src").alias("package")).agg(F.count("dst").alias("ce"))
    ca = foreign.groupBy(F.col("dst").alias("package")).agg(F.count("src").alias("ca"))
    joined = packages.join(ce, "package", "left").join(ca, "package", "left").na.fill(0, ["ce", "ca"])
    return joined.withColumn("instability", F.coalesce(F.try_divide(F.col("ce").cast("double"), F.col("ce") + F.col("ca")), F.lit(0.0)))


def hierarchy(methods: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The same sums on class, package and project level: one pass with grouping sets."""
    grouped = methods.rollup("package", "class").agg(*(v.alias(n) for n, v in values.items()), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "class").when(F.col("gid") == 1, "package").otherwise("project")
    entity = F.when(F.col("gid") == 0, F.col("class").cast("string")).when(F.col("gid") == 1, F.col("package").cast("string")).otherwise("all")
    return grouped.select(level.alias("level"), entity.alias("entity_id"), *values)


def long_form(wide: DataFrame, level: str, entity: str, parent: str, codes: list[str]) -> DataFrame:
    """Metric rows (level, entity_id, parent_id, code, value, is_integral, state) from one column per metric."""
    kinds = dict(wide.dtypes)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).cast("double").alias("value"), F.lit(kinds[c] in ("bigint", "int")).alias("is_integral")) for c in codes)))
    rows = wide.select(F.col(entity).cast("string").alias("entity_id"), F.col(parent).cast("string").alias("parent_id"), pairs.alias("m"))
    return rows.select(F.lit(level).alias("level"), "entity_id", "parent_id", "m.*", F.when(F.col("m.value").isNull(), "UNDEFINED").otherwise("DEFINED").alias("state"))
