"""Admission of arriving samples: in order, late within a window, repeated, too old, one series too many.

Samples are judged in arrival order (``seq``) against the newest time of their own
series.  With a fixed ``min_valid`` the sequential rule is a running maximum: a
sample newer than all before is always accepted, so the maximum over arrivals is
the maximum over accepted samples, and an earlier refused copy of a late sample
implies that the later copy is refused too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, LATE, DUPLICATE, TOO_OLD, REFUSED = "ok", "late", "duplicate", "too_old", "cardinality"
ADMITTED = (OK, LATE)


def classify(samples: DataFrame, window: int = 600_000, min_valid: int | None = None, order: tuple[str, ...] = ("seq",), stored: DataFrame | None = None, most_late: int | None = None) -> DataFrame:
    """samples (sid, t, v, ...) with ``verdict``. One shuffle, by series.

    ``stored``: (sid, t) admitted before.  ``most_late``: late samples a series may hold;
    further ones count as too old, later copies of those too.
    """
    valid = F.lit(True) if min_valid is None else F.col("t") >= min_valid
    arrival = Window.partitionBy("sid").orderBy(*order)
    before = arrival.rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(valid, F.col("t"))).over(before)
    copy = F.row_number().over(Window.partitionBy("sid", "t").orderBy(*order)) > 1
    if stored is not None:
        samples = samples.join(stored.groupBy("sid").agg(F.max("t").alias("_top")), "sid", "left").join(stored.distinct().withColumn("_held", F.lit(True)), ["sid", "t"], "left")
        newest, copy = F.greatest(newest, F.col("_top")), copy | F.coalesce("_held", F.lit(False))
    judged = samples.withColumn("_newest", newest).withColumn("_copy", copy)
    out = judged.withColumn("verdict", verdict(F.col("t"), F.col("_newest"), F.col("_copy"), window, valid))
    if most_late is not None:
        late = F.col("verdict") == LATE
        full = out.withColumn("_full", late & (F.count_if(late).over(arrival) > most_late))
        over = F.max("_full").over(Window.partitionBy("sid", "t"))
        out = full.withColumn("verdict", F.when(F.col("_full") | ((F.col("verdict") == DUPLICATE) & over), TOO_OLD).otherwise(F.col("verdict")))
    return out.drop("_newest", "_copy", "_top", "_held", "_full")


def verdict(t: Column, newest: Column, copy: Column, window: int, valid: Column) -> Column:
    return (
        F.when(~valid, TOO_OLD)
        .when(newest.isNull() | (t > newest), OK)
        .when(t == newest, DUPLICATE)
        .when(t < newest - window, TOO_OLD)
        .when(copy, DUPLICATE)
        .otherwise(LATE)
    )


def limit_series(samples: DataFrame, known: DataFrame, most: int, order: tuple[str, ...] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """(accepted samples, refused samples): new series beyond the limit are refused in order of their first arrival.

    A series takes its place at its first arrival, whether or not that sample is
    admitted later.  ``known``: the sids stored already.  First arrivals are aggregated
    per series, and only new series are ranked: the driver learns two counts.
    """
    first = samples.groupBy("sid").agg(F.min(F.struct(*order)).alias("_first")).join(known.select("sid"), "sid", "left_anti")
    room = max(0, most - known.count())
    new = first.count()
    if new <= room:
        return samples, samples.limit(0)
    # the limit bounds what is kept, not what is read: the new series in order, the first ``room`` of them
    kept = first.orderBy("_first").limit(room).select("sid").unionByName(known.select("sid"))
    return samples.join(kept, "sid", "left_semi"), samples.join(kept, "sid", "left_anti")


def counters(judged: DataFrame) -> DataFrame:
    """(verdict, n)."""
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))
