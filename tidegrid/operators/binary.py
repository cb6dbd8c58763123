"""Binary operators between vectors and scalars."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import BadData
from ..functions import ieee
from ..model import series_id, without_name
from .vectors import Grid, Scalar, Vector


def _one(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def _value(op: str, a: Column, b: Column) -> Column:
    return ieee.ARITHMETIC[op](a, b) if op in ieee.ARITHMETIC else _one(ieee.COMPARE[op](a, b))


def apply(spark: SparkSession, grid: Grid, op: str, as_bool: bool, left: Scalar | Vector, right: Scalar | Vector) -> Scalar | Vector:
    filters = op in ieee.COMPARE and not as_bool
    if isinstance(left, Scalar) and isinstance(right, Scalar):
        if filters:
            raise BadData("a comparison of scalars needs bool")
        return scalars(spark, grid, lambda a, b: _value(op, a, b), left, right)
    if isinstance(left, Vector) and isinstance(right, Vector):
        return _matched(left, right, op, filters)
    vector, scalar = (left, right) if isinstance(left, Vector) else (right, left)
    flip = vector is right
    f = (lambda v, s: ieee.COMPARE[op](s, v) if flip else ieee.COMPARE[op](v, s)) if filters else (lambda v, s: _value(op, s, v) if flip else _value(op, v, s))
    return vector.filter(f, scalar) if filters else vector.map(f, scalar)


def scalars(spark: SparkSession, grid: Grid, f, *args: Scalar) -> Scalar:
    if all(a.frame is None for a in args):
        return Scalar(column=f(*[a.column for a in args]))
    out, columns = grid.frame(spark), []
    for i, a in enumerate(args):
        if a.frame is None:
            columns.append(a.column)
        else:
            out = out.join(F.broadcast(a.frame.withColumnRenamed("s", f"s{i}")), "step_ts")
            columns.append(F.col(f"s{i}"))
    return Scalar(frame=out.select("step_ts", f(*columns).alias("s")))


def _matched(left: Vector, right: Vector, op: str, filters: bool) -> Vector:
    """One-to-one by all labels but the name.  Series are matched first, in the small table; values then meet by id and step."""
    key = series_id(without_name(F.col("label_key")))
    # only series with a point on the grid count
    r = right.series.join(right.values.select("sid").distinct(), "sid", "left_semi").select(key.alias("m"), "sid")
    unique = r.groupBy("m").agg(F.count("*").alias("n"), F.max("sid").alias("rsid"))
    checked = unique.select("m", F.when(F.col("n") == 1, F.col("rsid")).otherwise(F.raise_error(F.lit("many series on the right side of a binary operator match alike")).cast("long")).alias("rsid"))
    pairs = left.series.select(key.alias("m"), "sid").join(checked, "m").select("sid", "rsid")
    lv = left.values.join(pairs, "sid")
    rv = right.values.select(F.col("sid").alias("rsid"), "step_ts", F.col("v").alias("rv"))
    both = lv.join(rv, ["rsid", "step_ts"])
    a, b = F.col("v"), F.col("rv")
    if filters:
        return Vector(both.filter(ieee.COMPARE[op](a, b)).select("sid", "step_ts", "v"), left.series)
    return Vector(both.select("sid", "step_ts", _value(op, a, b).alias("v")), left.series).nameless()
