"""Rollups: five-minute buckets, and range functions answered from them with raw edges.

A bucket with end e covers (e - res, e].  A window (f, t] is the raw samples of
(f, a], the buckets ending in (a, b] and the raw samples of (b, t], where a is f
rounded up and b is t rounded down; if a > b it is all raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from .select import expand, first_step, last_step
from .vectors import Grid
from .windows import _merged, _partials

RESOLUTION = 300_000
ABLE = {"max_over_time", "min_over_time", "sum_over_time", "avg_over_time", "count_over_time", "last_over_time"}


def bucket_end(t: Column, res: int = RESOLUTION) -> Column:
    return t + F.pmod(-t, F.lit(res))


def build(samples: DataFrame, res: int = RESOLUTION) -> DataFrame:
    """(sid, e, mn, mx, sm, cnt, la): one row a series and bucket."""
    return reduced(samples.select("sid", bucket_end(F.col("t"), res).alias("e"), "t", "v"), "sid", "e")


def reduced(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, mn, mx, sm, cnt, la) of samples (*keys, t, v)."""
    v = F.col("v")
    last = F.max(F.struct("t", "v"))["v"]
    return rows.groupBy(*keys).agg(ieee.agg_min(v).alias("mn"), ieee.agg_max(v).alias("mx"), F.sum("v").alias("sm"), F.count("*").alias("cnt"), last.alias("la"))


def applies(name: str, w: int, grid: Grid, mode: str, res: int = RESOLUTION) -> bool:
    """Whether a query reads rollups: forced, or (auto) windows of half an hour at least that overlap little."""
    if name not in ABLE or mode == "off" or w < 2 * res:
        return False
    return mode == "force" or w >= 1_800_000 and (grid.n == 1 or 2 * grid.step >= w)


#: Ranges of raw samples asked for one by one; beyond that neighbours are read as one range.
RANGES = 128


def edges(w: int, offset: int, grid: Grid, res: int = RESOLUTION) -> list[tuple[int, int]]:
    """Ranges (both ends included) that hold the raw samples of all windows' edges; none on a grid of whole buckets."""
    found: list[tuple[int, int]] = []
    for i in range(grid.n):
        end = grid.start + i * grid.step - offset
        start = end - w
        found += [(start + 1, start + -start % res), (end - end % res + 1, end)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for x in found if x[0] <= x[1]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    each = -(-len(out) // RANGES) or 1
    return [(out[i][0], out[min(i + each, len(out)) - 1][1]) for i in range(0, len(out), each)]


def over_time(samples: DataFrame | None, rollups: DataFrame, name: str, w: int, offset: int, grid: Grid, res: int = RESOLUTION) -> DataFrame:
    """The same points as from raw samples (sums up to rounding); samples: those of the edges, None if there are none."""
    t = F.col("t")
    end = F.col("step_ts") - offset
    a, b = bucket_end(end - w, res), end - F.pmod(end, F.lit(res))
    pieces = {"max_over_time": ["mx"], "min_over_time": ["mn"], "sum_over_time": ["sm"], "avg_over_time": ["sm", "cnt"], "count_over_time": ["cnt"], "last_over_time": ["la"]}[name]
    bucket = rollups.withColumnRenamed("e", "t")
    whole = expand(bucket.select("sid", "t", *pieces), first_step(F.col("t"), grid, offset), last_step(F.col("t"), grid, offset, w), grid)
    whole = whole.filter((t > a) & (t <= b))
    if name == "last_over_time":
        whole = whole.withColumn("la", F.struct(F.col("t"), F.col("la").alias("v")))
    both = whole.select("sid", "step_ts", *pieces)
    if samples is not None:
        # a sample is raw only in the windows that start or end within its own bucket: few steps, not w / step;
        # a window is two buckets at least, so the two edges never meet
        tail = expand(samples, first_step(t, grid, offset), last_step(t, grid, offset, res), grid).filter(t > b)
        head = expand(samples, first_step(t + (w - res), grid, offset), last_step(t, grid, offset, w), grid).filter(t <= a)
        raw = head.unionByName(tail)
        state = raw.groupBy("sid", "step_ts").agg(*_partials(name, F.col("v"), F.col("t")))
        both = both.unionByName(state.select("sid", "step_ts", *pieces))
    return both.groupBy("sid", "step_ts").agg(_merged(name).alias("v"))
