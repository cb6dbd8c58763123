"""Plain tables as metrics: a time column, a value column and label columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAME, identified, label_key, series_id, series_of
from ..plans.engine import Store


@dataclass(frozen=True)
class Metric:
    """How a table's rows are samples of one metric."""

    name: str
    table: str
    time: str
    value: str
    labels: tuple[tuple[str, str], ...]
    order: str | None = None  # the first of samples of a series at one time counts, in this order
    named: str | None = None  # a column whose values make metrics of their own: name_value

    def map(self) -> Column:
        pairs = [x for k, c in self.labels for x in (F.lit(k), F.col(c).cast("string"))]
        name = F.lit(self.name) if self.named is None else F.concat_ws("_", F.lit(self.name), F.col(self.named))
        return F.create_map(F.lit(NAME), name, *pairs)

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet")

    def series(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Distinct label columns first: labels are built and hashed once a series."""
        return series_of(identified(self.rows(spark, sf_dir).select(*[c for _, c in self.labels], *([self.named] if self.named else [])).distinct().select(self.map().alias("labels"))))

    def size(self, spark: SparkSession, sf_dir: str) -> tuple[int, int]:
        """Number of rows and, about, of series."""
        labels = [c for _, c in self.labels] + ([self.named] if self.named else [])
        return tuple(self.rows(spark, sf_dir).agg(F.count("*"), F.approx_count_distinct(F.struct(*labels))).first())

    def samples(self, spark: SparkSession, sf_dir: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """(sid, t, v); the range is also put on the stored column, where Parquet statistics can use it."""
        rows = self.rows(spark, sf_dir)
        t = F.unix_millis(F.col(self.time).cast("timestamp"))
        if lo is not None:
            near = [F.timestamp_millis(F.lit(x)).cast("timestamp_ntz") for x in (lo, hi + 1)]
            rows = rows.filter((F.col(self.time) >= near[0]) & (F.col(self.time) <= near[1])).filter(t.between(lo, hi))
        out = rows.select(series_id(label_key(self.map())).alias("sid"), t.alias("t"), F.expr(self.value).cast("double").alias("v"), *([F.col(self.order).alias("seq")] if self.order else []))
        return out.groupBy("sid", "t").agg(F.min_by("v", "seq").alias("v")) if self.order else out


EVENTS = Metric("events_value", "events", "ts", "value", (("event_type", "event_type"), ("user_id", "user_id")))
ORDERS = Metric("orders_price", "orders", "o_orderdate", "o_totalprice", (("priority", "o_orderpriority"), ("status", "o_orderstatus")), "o_orderkey")
#: Ten metrics of hosts: five event types by value, five by the number in their properties.
USAGE = Metric("usage", "events", "ts", "value", (("hostname", "user_id"),), named="event_type")
DEPTH = Metric("depth", "events", "ts", "get_json_object(props, '$.k')", (("hostname", "user_id"),), named="event_type")


def store(spark: SparkSession, sf_dir: str, *metrics: Metric, rollups: DataFrame | None = None) -> Store:
    """A store over one or more metrics."""
    series = metrics[0].series(spark, sf_dir)
    for m in metrics[1:]:
        series = series.unionByName(m.series(spark, sf_dir))

    def scan(lo: int, hi: int) -> DataFrame:
        out = metrics[0].samples(spark, sf_dir, lo, hi)
        for m in metrics[1:]:
            out = out.unionByName(m.samples(spark, sf_dir, lo, hi))
        return out

    def size() -> tuple[int, int]:
        sizes = [m.size(spark, sf_dir) for m in metrics]
        return sum(n for n, _ in sizes), sum(n for _, n in sizes)

    return Store(series, scan, rollups, size)
