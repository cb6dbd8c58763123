"""Aggregation across series at each step."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..model import drop, only
from .vectors import Scalar, Vector


def group_key(by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> Column:
    key = F.col("label_key")
    if without is not None:
        return drop(key, list(without))
    return only(key, list(by or ()))


def _quantile(phi: Column, s: Column) -> Column:
    """Linear interpolation on a sorted array."""
    n = F.size(s)
    rank = phi * (n - 1)
    lo = F.floor(rank).cast("int")
    hi = F.least(n - 1, lo + 1)
    part = rank - lo
    a, b = F.element_at(s, lo + 1), F.element_at(s, hi + 1)
    return F.when(F.isnan(phi), ieee.nan()).when(phi < 0, ieee.inf(-1)).when(phi > 1, ieee.inf()).otherwise(F.when(part == 0, a).otherwise(a * (1 - part) + b * part))


def aggregate(vector: Vector, op: str, by: tuple[str, ...] | None, without: tuple[str, ...] | None, parameter: Scalar | None) -> Vector:
    key = group_key(by, without)
    rows, groups = vector.regrouped(key)
    v = F.col("v")
    if op in ("topk", "bottomk"):
        return _top(vector, rows, op, parameter)
    if op == "quantile":
        return Vector(_quantiles(rows, parameter), groups)
    f = {
        "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "count": lambda: F.count("*").cast("double"), "group": lambda: F.max(F.lit(1.0)),
        "max": lambda: ieee.agg_max(v), "min": lambda: ieee.agg_min(v), "stddev": lambda: F.stddev_pop(v), "stdvar": lambda: F.var_pop(v),
    }[op]
    return Vector(rows.groupBy(F.col("gid").alias("sid"), "step_ts").agg(f().alias("v")), groups)


def _quantiles(rows, parameter: Scalar):
    keys = [F.col("gid").alias("sid"), F.col("step_ts")]
    phi = parameter.literal
    if phi is not None and 0 <= phi <= 1:
        return rows.groupBy(*keys).agg(F.percentile("v", F.lit(phi)).alias("v"))
    if parameter.frame is None:
        # outside [0, 1] the values do not matter; a step expression needs them sorted
        sorted_ = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("a"))
        return sorted_.select("sid", "step_ts", _quantile(parameter.column, F.col("a")).alias("v"))
    sorted_ = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("a")).join(F.broadcast(parameter.frame), "step_ts")
    return sorted_.select("sid", "step_ts", _quantile(F.col("s"), F.col("a")).alias("v"))


def _top(vector: Vector, rows, op: str, parameter: Scalar) -> Vector:
    """The k highest or lowest of each group and step with all their labels; ties go by label set.

    A literal k lets Spark cut every task's input to k rows a group before the exchange.
    """
    labelled = rows.join(vector.series, "sid")
    order = F.col("v").desc() if op == "topk" else F.col("v").asc()
    ranked = labelled.withColumn("_n", F.row_number().over(Window.partitionBy("gid", "step_ts").orderBy(order, "label_key", "sid")))
    if parameter.literal is not None:
        k = parameter.literal
        kept = ranked.filter(F.col("_n") <= int(min(max(k, 0), 2**31 - 1)) if k == k else F.lit(False))
    elif parameter.frame is None:
        kept = ranked.filter(F.col("_n") <= F.when(F.isnan(parameter.column), 0).otherwise(parameter.column.cast("int")))
    else:
        kept = ranked.join(F.broadcast(parameter.frame), "step_ts").filter(F.col("_n") <= F.when(F.isnan("s"), F.lit(0.0)).otherwise(F.col("s")).cast("int"))
    return Vector(kept.select("sid", "step_ts", "v"), vector.series)
