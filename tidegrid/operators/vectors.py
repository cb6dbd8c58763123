"""Step vectors and per-step scalars.

A vector is two tables: values ``(sid, step_ts, v)`` and the series they belong to
``(sid, label_key)``.  Values travel through shuffles without their labels, and
operators that only change labels touch the series alone.  An absent row is an
absent point; NaN is a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import series_id, without_name


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... (n of them), in milliseconds."""

    start: int
    step: int
    n: int

    @property
    def end(self) -> int:
        return self.start + (self.n - 1) * self.step

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select((F.lit(self.start) + F.col("id") * self.step).alias("step_ts"))


@dataclass(frozen=True)
class Scalar:
    """A value for each step: an expression of ``step_ts``, or a table (step_ts, s) with a row for every step."""

    column: Column | None = None
    frame: DataFrame | None = None
    literal: float | None = None

    @classmethod
    def of(cls, value: float) -> Scalar:
        return cls(column=F.lit(float(value)), literal=float(value))


@dataclass(frozen=True)
class Vector:
    values: DataFrame
    series: DataFrame

    def nameless(self) -> Vector:
        return Vector(self.values, self.series.select("sid", without_name(F.col("label_key")).alias("label_key")))

    def with_scalars(self, *scalars: Scalar) -> tuple[DataFrame, list[Column]]:
        """Values with each scalar beside them; a table of steps is at most the step limit long, so it is broadcast."""
        out, columns = self.values, []
        for i, s in enumerate(scalars):
            if s.frame is None:
                columns.append(s.column)
            else:
                out = out.join(F.broadcast(s.frame.withColumnRenamed("s", f"s{i}")), "step_ts")
                columns.append(F.col(f"s{i}"))
        return out, columns

    def map(self, f, *scalars: Scalar, keep_name: bool = False) -> Vector:
        """f(v, scalars...) on every point."""
        rows, columns = self.with_scalars(*scalars)
        made = Vector(rows.select("sid", "step_ts", f(F.col("v"), *columns).alias("v")), self.series)
        return made if keep_name else made.nameless()

    def filter(self, f, *scalars: Scalar) -> Vector:
        rows, columns = self.with_scalars(*scalars)
        return Vector(rows.filter(f(F.col("v"), *columns)).select("sid", "step_ts", "v"), self.series)

    def labelled(self) -> DataFrame:
        """(sid, label_key, step_ts, v)."""
        return self.values.join(self.series, "sid").select("sid", "label_key", "step_ts", "v")

    def regrouped(self, key: Column) -> tuple[DataFrame, DataFrame]:
        """(values with gid, (gid, label_key)): series mapped to groups of the given label key."""
        keyed = self.series.select("sid", key.alias("g"))
        map_ = keyed.select("sid", series_id(F.col("g")).alias("gid"))
        groups = keyed.select("g").distinct().select(series_id(F.col("g")).alias("sid"), F.col("g").alias("label_key"))
        return self.values.join(map_, "sid"), groups
