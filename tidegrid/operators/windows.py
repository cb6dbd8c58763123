"""Range functions over left-open windows (step - w, step] of each series.

Samples are expanded to the steps whose windows hold them by integer arithmetic
(no range join) and aggregated by hash.  Where the window is a multiple of the
step, samples are first reduced to one partial a step, and the partials are
expanded: the fan-out then is by steps, not by samples.  All partials merge.  A
counter's drop belongs to a window only if the sample before it does, so the drop
of a partial's first sample stays apart until the window is known: nothing is added
that would have to be taken off again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from .select import expand, first_step, floor_div, last_step
from .vectors import Grid

SIMPLE = {"max_over_time", "min_over_time", "sum_over_time", "avg_over_time", "count_over_time", "present_over_time", "last_over_time"}
RATES = {"rate", "increase", "delta"}


def _partials(name: str, v: Column, t: Column) -> list[Column]:
    """Mergeable state of a simple function over raw samples."""
    many = {
        "max_over_time": lambda: [ieee.agg_max(v).alias("mx")],
        "min_over_time": lambda: [ieee.agg_min(v).alias("mn")],
        "sum_over_time": lambda: [F.sum(v).alias("sm")],
        "avg_over_time": lambda: [F.sum(v).alias("sm"), F.count("*").alias("cnt")],
        "count_over_time": lambda: [F.count("*").alias("cnt")],
        "present_over_time": lambda: [F.lit(1.0).alias("one")],
        "last_over_time": lambda: [F.max(F.struct(t.alias("t"), v.alias("v"))).alias("la")],
    }
    return many[name]()


def _merged(name: str) -> Column:
    """The value from partials, aggregated."""
    if name == "max_over_time":
        return ieee.agg_max(F.col("mx"))
    if name == "min_over_time":
        return ieee.agg_min(F.col("mn"))
    if name == "sum_over_time":
        return F.sum("sm")
    if name == "avg_over_time":
        return F.sum("sm") / F.sum("cnt")
    if name == "count_over_time":
        return F.sum("cnt").cast("double")
    if name == "present_over_time":
        return F.max("one")
    return F.max("la")["v"]


def bucketed(w: int, grid: Grid) -> bool:
    """Whether samples are reduced to a partial a step before they are expanded."""
    return w % grid.step == 0 and w // grid.step >= 2 and grid.n > 1


def over_time(samples: DataFrame, name: str, w: int, offset: int, grid: Grid) -> DataFrame:
    """(sid, step_ts, v) of a range function over samples (sid, t, v)."""
    if name in RATES:
        return _rates(samples, name, w, offset, grid)
    if name == "irate":
        return _irate(samples, w, offset, grid)
    if name in ("stddev_over_time", "stdvar_over_time"):
        f = F.stddev_pop if name == "stddev_over_time" else F.var_pop
        rows = expand(samples, first_step(F.col("t"), grid, offset), last_step(F.col("t"), grid, offset, w), grid)
        return rows.groupBy("sid", "step_ts").agg(f("v").alias("v"))
    if bucketed(w, grid):
        # the bucket that ends at step b - 1 + j is in the windows of the next w / step steps
        own = samples.withColumn("_b", floor_div(F.col("t") + (offset - grid.start + grid.step - 1), grid.step))
        part = own.groupBy("sid", "_b").agg(*_partials(name, F.col("v"), F.col("t")))
        rows = expand(part, F.greatest(F.lit(0), F.col("_b")), F.col("_b") + (w // grid.step - 1), grid)
        return rows.groupBy("sid", "step_ts").agg(_merged(name).alias("v"))
    rows = expand(samples, first_step(F.col("t"), grid, offset), last_step(F.col("t"), grid, offset, w), grid)
    state = _partials(name, F.col("v"), F.col("t"))
    return rows.groupBy("sid", "step_ts").agg(*state).select("sid", "step_ts", _single(name).alias("v"))


def _single(name: str) -> Column:
    return {
        "max_over_time": F.col("mx"), "min_over_time": F.col("mn"), "sum_over_time": F.col("sm"), "avg_over_time": F.col("sm") / F.col("cnt"),
        "count_over_time": F.col("cnt").cast("double"), "present_over_time": F.col("one"), "last_over_time": F.col("la.v"),
    }[name]


#: Windows to a cell of time; a long series is as many groups as it has cells.
CELL_WINDOWS = 16


def _lagged(samples: DataFrame, w: int) -> DataFrame:
    """Each sample with the one before it in its series, if that is less than w older.

    An older one shares no window with the sample, and is left out.  So a series is cut into cells of time, and
    only the samples of a cell's last w go to the next cell as well.
    """
    size = w * CELL_WINDOWS
    own = floor_div(F.col("t"), size)
    cells = F.when(F.pmod(F.col("t"), F.lit(size)) >= size - w, F.array(own, own + 1)).otherwise(F.array(own))
    rows = samples.select("sid", "t", "v", F.explode(cells).alias("_cell"))
    before = Window.partitionBy("sid", "_cell").orderBy("t")
    lagged = rows.select("sid", "t", "v", "_cell", F.lag("v").over(before).alias("pv"), F.lag("t").over(before).alias("pt"))
    return lagged.filter(F.col("_cell") == own).drop("_cell")


def _irate(samples: DataFrame, w: int, offset: int, grid: Grid) -> DataFrame:
    rows = expand(_lagged(samples, w), first_step(F.col("t"), grid, offset), last_step(F.col("t"), grid, offset, w), grid)
    last = rows.groupBy("sid", "step_ts").agg(F.max(F.struct("t", "v", "pv", "pt")).alias("x"))
    inside = F.col("x.pt") > F.col("step_ts") - (w + offset)
    v, pv = F.col("x.v"), F.col("x.pv")
    rise = F.when(ieee.COMPARE["<"](v, pv), v).otherwise(v - pv)
    out = last.filter(inside).select("sid", "step_ts", ieee.div(rise, (F.col("x.t") - F.col("x.pt")) / 1000).alias("v"))
    return out.filter(~F.isnan("v"))


def _rates(samples: DataFrame, name: str, w: int, offset: int, grid: Grid) -> DataFrame:
    """Extrapolated rate, increase and delta from mergeable counts, ends and drops."""
    counter = name != "delta"
    drop = F.when(F.col("pv").isNotNull() & ieee.COMPARE["<"](F.col("v"), F.col("pv")), F.col("pv")).otherwise(F.lit(0.0))
    rows = _lagged(samples, w).select("sid", "t", "v", "pt", drop.alias("d"))
    opens = F.col("step_ts") - (w + offset)
    if bucketed(w, grid):
        bucket = lambda t: floor_div(F.col(t) + (offset - grid.start + grid.step - 1), grid.step)
        own = rows.withColumn("_b", bucket("t"))
        inner = F.when(bucket("pt") == F.col("_b"), F.col("d")).otherwise(0.0)
        part = own.groupBy("sid", "_b").agg(F.count("*").alias("n"), F.min(F.struct("t", "v", "pt", "d")).alias("f"), F.max(F.struct("t", "v")).alias("l"), F.sum(inner).alias("c"))
        rows = expand(part, F.greatest(F.lit(0), F.col("_b")), F.col("_b") + (w // grid.step - 1), grid)
        # the drop between two partials counts where both lie in the window
        between = F.when(F.col("f.pt") > opens, F.col("f.d")).otherwise(0.0)
        state = rows.groupBy("sid", "step_ts").agg(F.sum("n").alias("n"), F.min("f").alias("f"), F.max("l").alias("l"), F.sum(F.col("c") + between).alias("c"))
    else:
        rows = expand(rows, first_step(F.col("t"), grid, offset), last_step(F.col("t"), grid, offset, w), grid)
        inside = F.when(F.col("pt") > opens, F.col("d")).otherwise(0.0)
        state = rows.groupBy("sid", "step_ts").agg(F.count("*").alias("n"), F.min(F.struct("t", "v")).alias("f"), F.max(F.struct("t", "v")).alias("l"), F.sum(inside).alias("c"))
    end = F.col("step_ts") - offset
    v0, t0, t1 = F.col("f.v"), F.col("f.t"), F.col("l.t")
    grown = F.col("l.v") - v0 + (F.col("c") if counter else F.lit(0.0))
    span = (t1 - t0) / 1000
    x = state.filter("n >= 2").select("sid", "step_ts", grown.alias("r"), v0.alias("v0"), span.alias("span"), (span / (F.col("n") - 1)).alias("gap"), ((t0 - end + w) / 1000).alias("head"), ((end - t1) / 1000).alias("tail"))
    if counter:  # a counter starts at zero: no further back than that
        zero = F.col("span") * ieee.div(F.col("v0"), F.col("r"))
        x = x.withColumn("head", F.when(ieee.COMPARE[">"](F.col("r"), F.lit(0.0)) & ieee.COMPARE[">="](F.col("v0"), F.lit(0.0)) & ieee.COMPARE["<"](zero, F.col("head")), zero).otherwise(F.col("head")))
    reach = lambda side: F.when(F.col(side) < F.col("gap") * 1.1, F.col(side)).otherwise(F.col("gap") / 2)
    factor = (F.col("span") + reach("head") + reach("tail")) / F.col("span")
    if name == "rate":
        factor = factor / (w / 1000)
    return x.select("sid", "step_ts", (F.col("r") * factor).alias("v")).filter(~F.isnan("v"))
