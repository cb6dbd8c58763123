"""Comparison of two copies of the samples, and their repair by union.

Each copy is reduced to a digest for each range of series hashes; ranges that
differ are reduced again by series and hour; only the rows of differing hours are
compared.  So equal copies cost one aggregation each, and no row of an equal range
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000
RANGES = 4096


def row_hash() -> Column:
    """A hash of a sample: the value by its text, so that 0.0 and -0.0 differ."""
    return F.xxhash64("sid", "t", F.col("v").cast("string"))


def range_of(n: int = RANGES) -> Column:
    return F.pmod(F.xxhash64("sid"), F.lit(n)).cast("int")


def hour_of() -> Column:
    return F.col("t") - F.pmod(F.col("t"), F.lit(HOUR))


def _digest(samples: DataFrame, keys: dict[str, Column]) -> DataFrame:
    return samples.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n"), F.bit_xor(row_hash()).alias("x"))


def _differing(a: DataFrame, b: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Keys under which the digests differ, or that one side lacks."""
    x, y = _digest(a, keys), _digest(b, keys)
    tagged = x.withColumn("_side", F.lit(1)).unionByName(y.withColumn("_side", F.lit(2)))
    grouped = tagged.groupBy(*keys).agg(F.count("*").alias("sides"), F.min(F.struct("n", "x")).alias("lo"), F.max(F.struct("n", "x")).alias("hi"))
    return grouped.filter((F.col("sides") < 2) | (F.col("lo") != F.col("hi"))).select(*keys)


def digests(samples: DataFrame, n: int = RANGES) -> DataFrame:
    """(range, n, x): the digest of each range of series."""
    return _digest(samples, {"range": range_of(n)})


def differing_hours(a: DataFrame, b: DataFrame, n: int = RANGES) -> DataFrame:
    """(sid, hour) at which two copies differ."""
    ranges = _differing(a, b, {"range": range_of(n)})
    # at most n rows of one integer: small whatever the input
    near = [x.withColumn("range", range_of(n)).join(F.broadcast(ranges), "range", "left_semi") for x in (a, b)]
    return _differing(near[0], near[1], {"sid": F.col("sid"), "hour": hour_of()})


def missing(a: DataFrame, b: DataFrame, n: int = RANGES) -> DataFrame:
    """Samples (sid, t, v) of a whose (sid, t) b lacks."""
    hours = differing_hours(a, b, n)
    mine = a.withColumn("hour", hour_of()).join(hours, ["sid", "hour"], "left_semi").select("sid", "t", "v")
    other = b.withColumn("hour", hour_of()).join(hours, ["sid", "hour"], "left_semi").select("sid", "t")
    return mine.join(other, ["sid", "t"], "left_anti")


def repaired(a: DataFrame, b: DataFrame) -> DataFrame:
    """b with what only a has."""
    return b.select("sid", "t", "v").unionByName(missing(a, b))
