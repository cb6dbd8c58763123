"""Scalar and vector functions, and quantiles of classic histograms."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BadData
from ..functions import ieee
from ..model import NAME, label, series_id
from .vectors import Grid, Scalar, Vector

MATH = {
    "abs": F.abs, "ceil": ieee.ceil, "floor": ieee.floor, "sqrt": F.sqrt, "exp": F.exp,
    "ln": lambda v: ieee.log(v, F.ln), "log2": lambda v: ieee.log(v, F.log2), "log10": lambda v: ieee.log(v, F.log10),
    "round": lambda v, to: ieee.round_to(v, to),
    "clamp_min": ieee.clamp_min, "clamp_max": ieee.clamp_max, "clamp": lambda v, lo, hi: ieee.clamp_max(ieee.clamp_min(v, lo), hi),
}


def call(spark: SparkSession, grid: Grid, name: str, args: list[Scalar | Vector]) -> Scalar | Vector:
    if name == "time":
        return Scalar(column=F.col("step_ts") / F.lit(1000.0))
    if name == "vector":
        return _vector(spark, grid, _scalar_arg(name, args[0]))
    if name == "scalar":
        return _scalar(spark, grid, _vector_arg(name, args[0]))
    if name == "histogram_quantile":
        return histogram_quantile(_scalar_arg(name, args[0]), _vector_arg(name, args[1]))
    rest = [_scalar_arg(name, a) for a in args[1:]]
    if name == "round" and not rest:
        rest = [Scalar.of(1)]
    return _vector_arg(name, args[0]).map(MATH[name], *rest)


def _vector_arg(name: str, x: Scalar | Vector) -> Vector:
    if not isinstance(x, Vector):
        raise BadData(f"{name} needs a vector")
    return x


def _scalar_arg(name: str, x: Scalar | Vector) -> Scalar:
    if not isinstance(x, Scalar):
        raise BadData(f"{name} needs a scalar")
    return x


def _vector(spark: SparkSession, grid: Grid, s: Scalar) -> Vector:
    empty = spark.range(1).select(F.expr("cast(array() as array<struct<key:string,value:string>>)").alias("label_key")).select(series_id(F.col("label_key")).alias("sid"), "label_key")
    steps = grid.frame(spark).select("step_ts", s.column.alias("v")) if s.frame is None else s.frame.select("step_ts", F.col("s").alias("v"))
    return Vector(steps.crossJoin(F.broadcast(empty.select("sid"))).select("sid", "step_ts", "v"), empty)


def _scalar(spark: SparkSession, grid: Grid, x: Vector) -> Scalar:
    """The value where exactly one series has a point, else NaN."""
    one = x.values.groupBy("step_ts").agg(F.count("*").alias("n"), F.max("v").alias("s"))
    steps = grid.frame(spark).join(one, "step_ts", "left")
    return Scalar(frame=steps.select("step_ts", F.coalesce(F.when(F.col("n") == 1, F.col("s")), ieee.nan()).alias("s")))


def histogram_quantile(phi: Scalar, x: Vector) -> Vector:
    """Buckets are the series with a label ``le``; counts are made monotonic; linear inside a bucket."""
    text = label(F.col("label_key"), "le")
    le = F.when(text.rlike(r"^[+]?(?i:inf|infinity)$"), ieee.inf()).when(text.rlike(r"^-(?i:inf|infinity)$"), ieee.inf(-1)).otherwise(
        F.coalesce(text.try_cast("double"), F.raise_error(F.concat(F.lit("bad bucket bound "), text)).cast("double"))
    )
    group = F.filter("label_key", lambda e: ~e["key"].isin("le", NAME))
    has = x.series.filter(text != "").select("sid", le.alias("le"), group.alias("g"))
    map_ = has.select("sid", "le", series_id(F.col("g")).alias("gid"))
    groups = has.select("g").distinct().select(series_id(F.col("g")).alias("sid"), F.col("g").alias("label_key"))
    w = Window.partitionBy("gid", "step_ts").orderBy("le")
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("gid", "step_ts")
    rows = x.values.join(map_, "sid").select("gid", "step_ts", "le", F.max("v").over(up).alias("m"), F.row_number().over(w).alias("i"), F.lag("le").over(w).alias("pl"))
    rows = rows.select("*", F.coalesce(F.lag("m").over(w), F.lit(0.0)).alias("pm"), F.count("*").over(whole).alias("n"), F.max("m").over(whole).alias("tot"), F.max("le").over(whole).alias("top"))
    if phi.frame is None:
        rows, p = rows.withColumn("phi", phi.column), F.col("phi")
    else:
        rows, p = rows.join(F.broadcast(phi.frame.withColumnRenamed("s", "phi")), "step_ts"), F.col("phi")
    rank = p * F.col("tot")
    good = rows.filter((F.col("n") >= 2) & (F.col("top") == float("inf")))
    reached = good.filter((F.col("m") >= rank) | (F.col("i") == F.col("n")))
    low = F.coalesce(F.col("pl"), F.lit(0.0))
    inside = low + (F.col("le") - low) * ieee.div(rank - F.col("pm"), F.col("m") - F.col("pm"))
    value = (
        F.when(F.isnan(p), ieee.nan()).when(p < 0, ieee.inf(-1)).when(p > 1, ieee.inf()).when(F.col("tot") == 0, ieee.nan()).when(F.col("i") == F.col("n"), F.col("pl"))
        .when((F.col("i") == 1) & (F.col("le") <= 0), F.col("le")).when(F.col("m") == F.col("pm"), ieee.nan()).otherwise(inside)
    )
    first = reached.groupBy(F.col("gid").alias("sid"), "step_ts").agg(F.min_by(value, "i").alias("v"))
    return Vector(first, groups)
