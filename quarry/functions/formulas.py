"""Closed formulas of derived metrics over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.value import wrap32


def halstead(n1: Column, n2: Column, big_n1: Column, big_n2: Column) -> dict[str, Column]:
    """The six measures from distinct and total operators (n1, N1) and operands (n2, N2); all must be above 0.

    Length and vocabulary follow the catalogue's own definitions: ``vocabulary`` is computed like the volume.
    The effort's integer numerator wraps at 32 bits; its logarithm is natural, and errors are a 3000th of it.
    """
    volume = (big_n1 + big_n2) * (F.ln((n1 + n2).cast("double")) / F.ln(F.lit(2.0)))
    difficulty = (n1 / F.lit(2.0)) * (big_n2 / n2.cast("double"))
    numerator = wrap32(wrap32(n1 * big_n2) * (big_n1 + big_n2))
    effort = numerator * F.ln((n1 + n2).cast("double")) / (2 * n2)
    return {
        "volume": volume,
        "difficulty": difficulty,
        "length": (F.lit(2.0) / n1) * (n2.cast("double") / big_n2),
        "effort": effort,
        "vocabulary": volume,
        "errors": effort / 3000,
    }


def maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    """Index of a method or package: 0 to 100; 0 where an input isn't positive, null where one is null."""
    raw = (F.lit(171.0) - 5.2 * F.ln(volume) - 0.23 * F.ln(complexity) - 16.2 * F.ln(lines)) * 100 / 171
    positive = (volume > 0) & (complexity > 0) & (lines > 0)
    return F.when(positive.isNotNull() & ~positive, 0.0).otherwise(F.when(positive, F.greatest(F.lit(0.0), raw)))


def class_maintainability(volume: Column, complexity_sum: Column, lines: Column) -> Column:
    """Index of a class: the complexity enters as it is, not as a logarithm."""
    raw = (F.lit(171.0) - 5.2 * F.ln(volume) - 0.23 * complexity_sum - 16.2 * F.ln(lines)) * 100 / 171
    return F.when((volume > 0) & (complexity_sum > 0) & (lines > 0), F.greatest(F.lit(0.0), raw))


def project_maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    """Resilient index: inputs count as 1 at least, the result lies in 0 to 100."""
    v, c, n = (F.ln(F.greatest(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(1.0)))) for x in (volume, complexity, lines))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.lit(171.0) - 5.2 * v - 0.23 * c - 16.2 * n) * 100 / 171))


def design_quality(z: dict[str, Column]) -> dict[str, Column]:
    """Six design attributes as weighted sums of z-scores."""
    return {
        "reusability": -0.25 * z["coupling"] + 0.25 * z["cohesion"] + 0.5 * z["messaging"] + 0.5 * z["size"],
        "flexibility": 0.25 * z["encapsulation"] - 0.25 * z["coupling"] + 0.5 * z["composition"] + 0.5 * z["polymorphism"],
        "understandability": -0.33 * z["abstraction"] + 0.33 * z["encapsulation"] - 0.33 * z["coupling"] + 0.33 * z["cohesion"] - 0.33 * z["polymorphism"] - 0.33 * z["complexity"] - 0.33 * z["size"],
        "functionality": 0.12 * z["cohesion"] + 0.22 * z["polymorphism"] + 0.22 * z["messaging"] + 0.22 * z["size"] + 0.22 * z["hierarchies"],
        "extendibility": 0.5 * z["abstraction"] - 0.5 * z["coupling"] + 0.5 * z["inheritance"] + 0.5 * z["polymorphism"],
        "effectiveness": 0.2 * z["abstraction"] + 0.2 * z["encapsulation"] + 0.2 * z["composition"] + 0.2 * z["inheritance"] + 0.2 * z["polymorphism"],
    }
