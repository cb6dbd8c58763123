"""Digits of results are rounded as their SQL rounds them."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tidegrid.functions import ieee

PAIRS = [(208.82, 12.8), (13.42, 12.8), (102.71, 6.4), (107.01, 6.4), (105.96, 25.6), (1.0, 3.0), (-208.82, 12.8), (0.0, 1.0), (float("inf"), 1.0), (float("-inf"), 1.0), (1e307, 1.0), (5e-7, 1.0), (-5e-7, 1.0)]


def test_ratios_between_two_roundings(spark):
    rows = spark.createDataFrame(PAIRS, "a double, b double").select("a", "b", ieee.round_digits(F.col("a") / F.col("b"), 6).alias("r")).collect()
    db = duckdb.connect()
    for r in rows:
        assert r.r == db.execute("SELECT round(?::DOUBLE / ?::DOUBLE, 6)", [r.a, r.b]).fetchall()[0][0], r
    assert spark.range(1).select(F.isnan(ieee.round_digits(ieee.nan(), 6))).first()[0]
