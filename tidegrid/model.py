"""Tables of the engine: samples, series and step vectors.

``samples(sid, t, v)`` are keyed by a hash of the label set; ``series(sid, labels,
label_key)`` has a row for each label set.  ``label_key`` is the sorted array of
(key, value) structs: unlike a map it can be grouped, joined and ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "__name__"
LABEL_KEY = "array<struct<key:string,value:string>>"
SAMPLES = "sid long, t long, v double"
SERIES = f"sid long, labels map<string,string>, label_key {LABEL_KEY}"


def label_key(labels: Column) -> Column:
    """The identity of a label map: sorted entries, empty values dropped."""
    return F.array_sort(F.map_entries(F.map_filter(labels, lambda k, v: v.isNotNull() & (v != "")))).cast(LABEL_KEY)


def series_id(key: Column) -> Column:
    return F.xxhash64(key)


def identified(rows: DataFrame) -> DataFrame:
    """rows with a ``labels`` map get ``label_key`` and ``sid``."""
    return rows.withColumn("label_key", label_key(F.col("labels"))).withColumn("sid", series_id(F.col("label_key")))


def series_of(rows: DataFrame) -> DataFrame:
    """The series table of identified rows; raises if two label sets share an id."""
    by_id = rows.groupBy("sid").agg(F.min("label_key").alias("label_key"), F.max("label_key").alias("other"))
    checked = F.when(F.col("label_key") == F.col("other"), F.col("label_key")).otherwise(F.raise_error(F.lit("two series share an id")).cast(LABEL_KEY))
    return by_id.select("sid", F.map_from_entries(checked).alias("labels"), checked.alias("label_key"))


def without_name(key: Column) -> Column:
    return F.filter(key, lambda x: x["key"] != NAME)


def only(key: Column, names: list[str]) -> Column:
    return F.filter(key, lambda x: x["key"].isin(names) if names else F.lit(False))


def drop(key: Column, names: list[str]) -> Column:
    return F.filter(key, lambda x: ~x["key"].isin([*names, NAME]))


def label(key: Column, name: str) -> Column:
    """The value of a label, "" if the series lacks it."""
    return F.coalesce(F.get(F.filter(key, lambda x: x["key"] == name), F.lit(0))["value"], F.lit(""))
