"""IEEE 754 arithmetic on Spark columns.

Spark orders NaN above all numbers, takes NaN for equal to itself, raises on
division by zero and returns NULL for the logarithm of 0; metrics need the rules
of floating point.  Every operator of the engine goes through these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def inf(sign: int = 1) -> Column:
    return F.lit(sign * float("inf"))


def div(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, nan()).otherwise(a % b)


def _both(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


COMPARE = {
    "==": lambda a, b: (a == b) & _both(a, b),
    "!=": lambda a, b: ~((a == b) & _both(a, b)),
    ">": lambda a, b: (a > b) & _both(a, b),
    "<": lambda a, b: (a < b) & _both(a, b),
    ">=": lambda a, b: (a >= b) & _both(a, b),
    "<=": lambda a, b: (a <= b) & _both(a, b),
}
ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": div,
    "%": mod,
    "^": F.pow,
}


def log(v: Column, f=F.ln) -> Column:
    return F.when(v == 0, inf(-1)).when(F.isnan(v) | (v < 0), nan()).otherwise(f(v))


def _whole(v: Column, f) -> Column:
    """ceil and floor give BIGINT: from 2**53 on every double is whole already."""
    return F.when(F.abs(v) < float(2**53), f(v).cast("double")).otherwise(v)


def ceil(v: Column) -> Column:
    return _whole(v, F.ceil)


def floor(v: Column) -> Column:
    return _whole(v, F.floor)


def round_to(v: Column, to: Column) -> Column:
    """Halves up, for negative numbers too."""
    return floor(div(v, to) + 0.5) * to


def round_digits(v: Column, digits: int) -> Column:
    """Halves away from zero, of the product in floating point as databases do it; Spark's round() goes by the printed digits."""
    scale = float(10**digits)
    out = F.round(v * scale, 0) / scale
    return F.when(F.isnan(out) | (F.abs(out) == inf()), v).otherwise(out)


def clamp_min(v: Column, lo: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(lo), nan()).otherwise(F.greatest(v, lo))


def clamp_max(v: Column, hi: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(hi), nan()).otherwise(F.least(v, hi))


def agg_max(v: Column) -> Column:
    """NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), nan())


def agg_min(v: Column) -> Column:
    """NaN sorts last, so min() already ignores it."""
    return F.min(v)
