"""Series selection and the expansion of samples to the steps whose windows hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import label
from ..plans.language import Matcher, pattern
from .vectors import Grid


def matches(m: Matcher, key: Column) -> Column:
    """A label matcher; a missing label is the empty string."""
    value = label(key, m.name)
    if m.op == "=":
        return value == m.value
    if m.op == "!=":
        return value != m.value
    found = value.rlike(pattern(m.value))
    return found if m.op == "=~" else ~found


def select_series(series: DataFrame, matchers: tuple[Matcher, ...]) -> DataFrame:
    out = series
    for m in matchers:
        out = out.filter(matches(m, F.col("label_key")))
    return out.select("sid", "label_key")


def floor_div(x: Column, by: int) -> Column:
    """Floor division of integers, exact over all of BIGINT: no detour through doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by)) if by != 1 else x


def first_step(t: Column, grid: Grid, offset: int) -> Column:
    """Number of the first step at or after t, from 0 on."""
    return F.greatest(F.lit(0), floor_div(t + (offset - grid.start + grid.step - 1), grid.step))


def last_step(t: Column, grid: Grid, offset: int, window: int) -> Column:
    """Number of the last step whose window (step - window, step] holds t."""
    return floor_div(t + (offset - grid.start + window - 1), grid.step)


def expand(rows: DataFrame, lo: Column, hi: Column, grid: Grid) -> DataFrame:
    """A row for each step lo..hi (clipped to the grid), with ``step_ts``; no join."""
    last = F.least(hi, F.lit(grid.n - 1))
    steps = rows.withColumn("_lo", lo).withColumn("_hi", last).filter("_lo <= _hi").withColumn("_i", F.explode(F.expr("sequence(_lo, _hi)")))
    return steps.withColumn("step_ts", F.lit(grid.start) + F.col("_i") * grid.step).drop("_lo", "_hi", "_i")
