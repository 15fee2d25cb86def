"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(low: Column, high: Column) -> Column:
    """``low..high`` as an array of longs; empty when ``high < low`` (``sequence`` would count down)."""
    low, high = low.cast("long"), high.cast("long")
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def number(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def pairs(array: Column) -> Column:
    """Neighbours in an array: ``array<struct<p, q>>``, one shorter than the array."""
    return let(array, lambda a: F.transform(upto(F.lit(0), F.size(a) - 2), lambda i: F.struct(F.get(a, i.cast("int")).alias("p"), F.get(a, (i + 1).cast("int")).alias("q"))))
