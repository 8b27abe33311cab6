"""Design factors of a class model: hiding, inheritance, polymorphism and coupling.

Inputs: ``classes`` (class, package), ``methods`` (class, signature, visibility, is_static), ``fields`` (class, name,
visibility), ``lines`` (class, ancestor; both among the classes), visibility being public, protected, package or private.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seen_by(classes: DataFrame, lines: DataFrame) -> DataFrame:
    """(class, package, near, far, others): classes that can see package members, protected ones besides, and all others."""
    sizes = classes.groupBy("package").agg((F.count("*") - 1).alias("near"))
    packages = classes.select(F.col("class").alias("ancestor"), F.col("package").alias("above"))
    far = lines.join(classes, "class").join(packages, "ancestor").filter("package != above").groupBy(F.col("ancestor").alias("class")).agg(F.count("*").alias("far"))
    total = classes.agg((F.count("*") - 1).alias("others"))  # one row
    return classes.join(sizes, "package").join(far, "class", "left").na.fill(0, ["far"]).crossJoin(F.broadcast(total))


def hiding(members: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """members, visible and factor: one less the share of classes that see a member; 0 for one class or no members."""
    kind = F.col("visibility")
    seen = F.when(kind == "public", F.col("others")).when(kind == "package", F.col("near")).when(kind == "protected", F.col("near") + F.col("far")).otherwise(0)
    sums = members.join(_seen_by(classes, lines), "class").agg(F.count("*").alias("members"), F.coalesce(F.sum(seen), F.lit(0)).alias("visible"), F.max("others").alias("others"))
    possible = F.col("members") * F.col("others")
    return sums.select("members", "visible", F.when(F.coalesce(possible, F.lit(0)) <= 0, 0.0).otherwise((possible - F.col("visible")) / possible).alias("factor"))


def _passed_on(members: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """Members of ancestors as their descendants (class) inherit them."""
    packages = classes.select(F.col("class").alias("ancestor"), F.col("package").alias("above"))
    kind = F.col("visibility")
    given = lines.join(classes, "class").join(packages, "ancestor").join(members.withColumnRenamed("class", "ancestor"), "ancestor")
    return given.filter(kind.isin("public", "protected") | ((kind == "package") & (F.col("package") == F.col("above"))))


def _factor(part: Column, whole: Column, none: float) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(none)


def method_inheritance(methods: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """inherited, available and factor: signatures that classes get from ancestors and don't declare anew."""
    inherited = _passed_on(methods, classes, lines).select("class", "signature").distinct().join(methods.select("class", "signature"), ["class", "signature"], "left_anti").agg(F.count("*").alias("inherited"))
    own = methods.select("class", "signature").distinct().agg(F.count("*").alias("own"))
    total = F.col("inherited") + F.col("own")
    return inherited.crossJoin(F.broadcast(own)).select("inherited", total.alias("available"), _factor(F.col("inherited"), total, 0.0).alias("factor"))


def field_inheritance(fields: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """inherited, available and factor: every inherited field counts, hidden ones too."""
    inherited = _passed_on(fields, classes, lines).agg(F.count("*").alias("inherited"))
    total = F.col("inherited") + F.col("own")
    return inherited.crossJoin(F.broadcast(fields.agg(F.count("*").alias("own")))).select("inherited", total.alias("available"), _factor(F.col("inherited"), total, 0.0).alias("factor"))


def polymorphism(methods: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """overriding, possible and factor: methods that override, over new ones times descendants; 1 if none could."""
    above = _passed_on(methods.filter("not is_static"), classes, lines).select("class", "signature").distinct()
    own = methods.filter("not is_static").join(above, ["class", "signature"], "left_semi").agg(F.count("*").alias("overriding"))
    again = methods.filter("not is_static").join(above, ["class", "signature"], "left_anti").select("class").unionByName(methods.filter("is_static").select("class"))
    down = lines.groupBy(F.col("ancestor").alias("class")).agg(F.count("*").alias("descendants"))
    possible = again.join(down, "class").agg(F.coalesce(F.sum("descendants"), F.lit(0)).alias("possible"))
    return own.crossJoin(F.broadcast(possible)).select("overriding", "possible", _factor(F.col("overriding"), F.col("possible"), 1.0).alias("factor"))


def coupling_factor(couplings: DataFrame, classes: DataFrame) -> DataFrame:
    """couplings and factor: directed dependencies over the pairs of classes; may pass 1 as types outside the project count."""
    n = classes.agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return couplings.agg(F.count("*").alias("couplings")).crossJoin(F.broadcast(n)).select("couplings", _factor(F.col("couplings"), pairs, 0.0).alias("factor"))
