"""Null, NaN and division rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

NAN = float("nan")


def nz(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0, null where either is null."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(NAN))).otherwise(a / F.when(b != 0, b))


def ieee_div(a: Column, b: Column) -> Column:
    """Floating division with infinities and NaN at zero, as IEEE has it."""
    inf = F.lit(float("inf"))
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, F.when(a.isNotNull(), at_zero)).otherwise(a / F.when(b != 0, b))


def gate(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


# Spark orders NaN above all numbers and equal to itself. These compare as IEEE
# 754 has it: any comparison with NaN is false. Null stays null.


def gt(a: Column, b: Column) -> Column:
    return (a > b) & ~F.isnan(a)


def ge(a: Column, b: Column) -> Column:
    return (a >= b) & ~F.isnan(a)


def lt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(b)


def le(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(b)


def sign(x: Column) -> Column:
    """1, -1 or 0; 0 for NaN, which is neither above nor below zero."""
    return F.when(gt(x, F.lit(0.0)), F.lit(1)).when(x < 0, F.lit(-1)).when(x.isNotNull(), F.lit(0)).cast("long")


def least_over(x: Column, w: WindowSpec, first: WindowSpec | None = None) -> Column:
    """The running least value: a scan that starts from the first value of the
    window and goes on to smaller ones. So a NaN that comes first stays, and one
    that comes later is passed over. ``first``: the window, ordered, if ``w`` is not."""
    start = F.first(x, ignorenulls=True).over(first if first is not None else w)
    return F.when(F.isnan(start), F.lit(NAN)).otherwise(F.min(F.when(~F.isnan(x), x)).over(w))


def greatest_over(x: Column, w: WindowSpec, first: WindowSpec | None = None) -> Column:
    """The running greatest value, by the rule of ``least_over``."""
    start = F.first(x, ignorenulls=True).over(first if first is not None else w)
    return F.when(F.isnan(start), F.lit(NAN)).otherwise(F.max(F.when(~F.isnan(x), x)).over(w))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """x between low and high; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))
