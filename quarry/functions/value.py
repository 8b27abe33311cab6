"""Column helpers for metric values.

A metric value is DEFINED, UNDEFINED or absent. Undefined values are rows with ``state = 'UNDEFINED'`` and a
null value; absent ones have no row. Integral values divide with truncation, as counts do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated_ratio(a: Column, b: Column) -> Column:
    """Quotient of integers towards zero; null for a zero divisor."""
    return F.when(b != 0, ((a - F.try_mod(a, b)) / b).cast("long"))


def wrap32(x: Column) -> Column:
    """A 64-bit integer reduced to 32 bits with sign, as 32-bit arithmetic overflows."""
    low = F.pmod(x.cast("long"), F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def contains(value: Column, low: Column, high: Column) -> Column:
    """Inclusive interval test; a null bound is open."""
    return F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))


def overshoot(value: Column, low: Column, high: Column) -> Column:
    """Distance to the interval, 0 inside."""
    return F.greatest(F.coalesce(value - high, F.lit(0.0)), F.coalesce(low - value, F.lit(0.0)), F.lit(0.0))


def severity_of(excess: Column) -> Column:
    return F.when(excess >= 2.0, "high").when(excess >= 1.2, "medium").otherwise("low")


def excess_ratio(value: Column, low: Column, high: Column) -> Column:
    """How many times a value is beyond its bound; 1 where a ratio makes no sense (bounds or values of 0 and less)."""
    return F.when((value > high) & (high > 0), value / high).when((value < low) & (value > 0), low / value).otherwise(1.0)


def severity(value: Column, low: Column, high: Column) -> Column:
    return severity_of(excess_ratio(value, low, high))


def satisfied_excess(value: Column, low: Column, high: Column) -> Column:
    """For conditions that hold: how far the value is beyond a lower bound, or below an upper one."""
    return F.greatest(
        F.lit(1.0),
        F.when(low > 0, value / low).otherwise(1.0),
        F.when((high > 0) & (value > 0), high / value).otherwise(1.0),
    )


def severity_rank(name: Column) -> Column:
    return F.when(name == "high", 3).when(name == "medium", 2).when(name == "low", 1)


def display(value: Column) -> Column:
    """At least one decimal and at most four, half to even; undefined values print N/A."""
    return F.coalesce(F.call_function("format_number", value, F.lit("0.0###")), F.lit("N/A"))


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("s"))), r'^\{"s":(.*)\}$', "$1")
