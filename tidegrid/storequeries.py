"""Registered queries of storage, admission, formats, limits and answers, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Api, export_lines
from .errors import QueryError
from .model import NAME, identified, label
from .monitor import Monitor
from .operators import admission, metadata, rollup
from .operators.vectors import Grid
from .plans.engine import Engine, Options
from .queries import _LAST6, _SAM, BOTH, DAY, HOUR, START, STEP, _over, _stored_events, engine, whole
from .shared import shared_dir
from .sources import fixtures, remotewrite
from .storage import Storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _labels(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[label(F.col("label_key"), n).alias(n) for n in BOTH], *more)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(labels, t, v, seq) of every event."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(fixtures.EVENTS.map().alias("labels"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"), F.col("event_id").alias("seq"))


def _place(spark: SparkSession, name: str) -> Storage:
    return Storage(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


# --- storage: batches that overlap, compaction, rollups, retention, sizes


def _twice(spark: SparkSession, sf_dir: str) -> Storage:
    """All events as one batch, and a third of them again, with other values, as a second."""
    rows, storage = _events(spark, sf_dir), _place(spark, "twice")
    storage.append(rows, 0)
    storage.append(rows.filter("seq % 3 = 0").withColumn("v", -F.col("v") - 1), 1)
    return storage


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from two batches that overlap: the first written counts."""
    storage = _twice(spark, sf_dir)
    return _labels(storage.samples().join(storage.series(), "sid"), "t", "v")


def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sample of each series, by a scan of the range from the first to the last time, after compaction."""
    storage = _twice(spark, sf_dir)
    storage.compact()
    lo, hi = whole(spark, sf_dir, fixtures.EVENTS)
    last = storage.scan(lo - STEP, hi).groupBy("sid").agg(F.max(F.struct("t", "v")).alias("x"), F.count("*").alias("n"))
    return _labels(last.join(storage.series(), "sid"), "n", F.col("x.t").alias("t"), F.col("x.v").alias("v"))


def stored_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets that compaction stores."""
    storage = _stored_events(spark, sf_dir)
    return _labels(storage.store().rollups.join(storage.series(), "sid"), "e", "mn", "mx", F.round("sm", 6).alias("sm"), "cnt", "la")


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each day that ten days of raw samples and twenty of rollups leave at the end of January."""
    storage = _stored_events(spark, sf_dir)
    storage.retain(START + 31 * DAY, 10 * DAY, 20 * DAY)
    raw = storage.samples().groupBy("block").agg(F.count("*").alias("raw"))
    rolled = storage.store().rollups.groupBy("block").agg(F.sum("cnt").alias("rolled"))
    return rolled.join(raw, "block", "left").select("block", F.coalesce("raw", F.lit(0)).alias("raw"), "rolled")


def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, first and last time of each day, and whether its files were measured."""
    return _stored_events(spark, sf_dir).stats().select("block", "samples", "first", "last", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("measured"))


QUERIES |= {"stored_samples": stored_samples, "stored_scan": stored_scan, "stored_rollups": stored_rollups, "retained": retained, "storage_stats": storage_stats}
ORACLE_SQL["stored_samples"] = f"WITH {_SAM} SELECT * FROM sam"
ORACLE_SQL["stored_scan"] = f"WITH {_SAM} SELECT event_type, user_id, count(*) AS n, max(t) AS t, arg_max(v, t) AS v FROM sam GROUP BY ALL"
ORACLE_SQL["stored_rollups"] = f"WITH {_SAM} SELECT event_type, user_id, t + ((300000 - t % 300000) % 300000) AS e, min(v) AS mn, max(v) AS mx, round(sum(v), 6) AS sm, count(*) AS cnt, arg_max(v, t) AS la FROM sam GROUP BY ALL"
_ENDS = "(t + ((300000 - t % 300000) % 300000))"
ORACLE_SQL["retained"] = f"""WITH {_SAM}, raw AS (SELECT t // {DAY} * {DAY} AS block, count(*) AS raw FROM sam GROUP BY 1), rolled AS (SELECT {_ENDS} // {DAY} * {DAY} AS block, count(*) AS rolled FROM sam GROUP BY 1)
    SELECT block, CASE WHEN block + {DAY} <= {START + 21 * DAY} THEN 0 ELSE coalesce(raw, 0) END AS raw, CAST(rolled AS BIGINT) AS rolled FROM rolled LEFT JOIN raw USING (block) WHERE block + {DAY} > {START + 11 * DAY}"""
ORACLE_SQL["storage_stats"] = f"WITH {_SAM} SELECT t // {DAY} * {DAY} AS block, count(*) AS samples, min(t) AS first, max(t) AS last, true AS measured FROM sam GROUP BY ALL"

# --- formats and writes


def remote_write_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as part of a compressed remote-write body (one a user), read again."""
    rows = _events(spark, sf_dir).select(F.col("labels")["user_id"].alias("user"), F.to_json("labels").alias("labels"), "t", "v")

    def body(part: pd.DataFrame) -> pd.DataFrame:
        import json

        series = [(json.loads(k), list(zip(g["t"].tolist(), g["v"].tolist(), strict=True))) for k, g in part.groupby("labels")]
        return pd.DataFrame({"content": [remotewrite.body_of(series)]})

    back = remotewrite.parse(rows.groupBy("user").applyInPandas(body, "content binary")).filter("error is null")
    return back.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), "t", "v")


def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and status of three writes: all events, the same again, and new series beyond the limit."""
    rows, storage = _events(spark, sf_dir), _place(spark, "writes")
    first = storage.write(rows, 0)
    again = storage.write(rows, 1, window=40 * DAY)
    renamed = rows.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("copy"), F.lit("1"))))
    beyond = storage.write(renamed, 2, most_series=storage.series().count())
    out = [(i, w.ok, w.late, w.duplicate, w.too_old, w.cardinality, w.status) for i, w in enumerate((first, again, beyond))]
    return spark.createDataFrame(out, "write long, ok long, late long, duplicate long, too_old long, cardinality long, status long")


def series_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted samples where only the first forty series of a stream may exist."""
    known = identified(_events(spark, sf_dir))
    kept, _ = admission.limit_series(known, known.select("sid").limit(0), 40)
    return _labels(kept, "seq", "v")


def late_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of events that arrive backwards, where a series may hold two late samples."""
    known = identified(_events(spark, sf_dir).withColumn("back", -F.col("t")))
    judged = admission.classify(known, 60 * DAY, None, ("back", "seq"), most_late=2)
    return judged.select("seq", "verdict")


def self_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the engine, scraped into its own storage and asked for again."""
    storage, monitor = _place(spark, "self"), Monitor()
    for verdict, n in _events(spark, sf_dir).groupBy(F.col("labels")["event_type"]).count().collect():
        monitor.count("events_total", n, kind=verdict)
    with monitor.timed("scrape"):
        monitor.gauge("up", 1)
    monitor.scrape(storage, START, 0)
    out = Engine(spark, storage.store(), Options()).query('events_total{job="tidegrid"}', START)
    return out.frame.select(label(F.col("label_key"), "kind").alias("kind"), label(F.col("label_key"), "instance").alias("instance"), "v")


QUERIES |= {"remote_write_round_trip": remote_write_round_trip, "write_results": write_results, "series_limit": series_limit, "late_cap": late_cap, "self_metrics": self_metrics}
ORACLE_SQL["remote_write_round_trip"] = f"WITH {_SAM} SELECT * FROM sam"
ORACLE_SQL["write_results"] = """SELECT 0::BIGINT AS write, count(*) AS ok, 0::BIGINT AS late, 0::BIGINT AS duplicate, 0::BIGINT AS too_old, 0::BIGINT AS cardinality, 204::BIGINT AS status FROM events
    UNION ALL SELECT 1, 0, 0, count(*), 0, 0, 204 FROM events UNION ALL SELECT 2, 0, 0, 0, 0, count(*), 422 FROM events"""
ORACLE_SQL["series_limit"] = """WITH s AS (SELECT event_type, user_id, min(event_id) AS f FROM events GROUP BY ALL ORDER BY f LIMIT 40)
    SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, event_id AS seq, value AS v FROM events SEMI JOIN s USING (event_type, user_id)"""
ORACLE_SQL["late_cap"] = """SELECT event_id AS seq, CASE row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id) WHEN 1 THEN 'ok' WHEN 2 THEN 'late' WHEN 3 THEN 'late' ELSE 'too_old' END AS verdict FROM events"""
ORACLE_SQL["self_metrics"] = "SELECT event_type AS kind, 'driver' AS instance, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL"

# --- answers, order, limits


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported series as lines of JSON."""
    return export_lines(metadata.export(fixtures.store(spark, sf_dir, fixtures.EVENTS), ["events_value"]))


def ordered_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of points in a result's order: by labels, then by time."""
    e = engine(spark, sf_dir, lookback=6 * HOUR)
    result = e.query_range('events_value{event_type="click"}', *whole(spark, sf_dir, fixtures.EVENTS), STEP)
    placed = result.placed(f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}")
    return placed.select("place", label(F.col("label_key"), "user_id").alias("user_id"), F.col("step_ts").alias("ts"), "v")


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each limit and each mistake in a query ends with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lo, hi = whole(spark, sf_dir, fixtures.EVENTS)
    cases = [
        ("series", {"max_series": 3}, "events_value", STEP), ("samples", {"max_samples": 10}, "events_value", STEP), ("steps", {"max_steps": 50}, "events_value", STEP), ("fits", {"max_series": 10**9, "max_samples": 10**9}, "events_value", STEP),
        ("no selector", {}, '{event_type!="x"}', STEP), ("only empty", {}, '{event_type=~".*"}', STEP), ("bad pattern", {}, 'm{a=~"("}', STEP), ("no range", {}, "rate(m)", STEP), ("string", {}, '"x"', STEP), ("bad step", {}, "m", 0),
    ]
    out = []
    for name, options, text, step in cases:
        try:
            engine(spark, sf_dir, lookback=6 * HOUR, **options).query_range(text, lo, hi, step)
            out.append((name, "success", 200))
        except QueryError as e:
            out.append((name, e.kind, e.status))
    return spark.createDataFrame(out, "name string, kind string, status long")


def rollup_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which windows are answered from rollups."""
    cases = [(f, w, step, mode) for f in ("max_over_time", "stddev_over_time") for w in (300_000, 600_000, 1_800_000, HOUR) for step in (60_000, 1_800_000, HOUR) for mode in ("off", "auto", "force")]
    out = [(f, w, step, mode, rollup.applies(f, w, Grid(START, step, 10), mode)) for f, w, step, mode in cases]
    return spark.createDataFrame(out, "f string, w long, step long, mode string, used boolean")


def build_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoints about the engine itself, and the number of its series."""
    api = Api(engine(spark, sf_dir))
    out = [("buildinfo", api.build_info()[0], int(bool(api.build_info()[1]["data"]["version"]))), ("metadata", api.metadata()[0], len(api.metadata()[1]["data"])), ("series", api.cardinality()[0], api.cardinality()[1]["data"]["headStats"]["numSeries"])]
    return spark.createDataFrame(out, "endpoint string, status long, n long")


def json_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range query through the API: points of each series of its JSON."""
    lo, hi = whole(spark, sf_dir, fixtures.EVENTS)
    api = Api(engine(spark, sf_dir, lookback=6 * HOUR), timeout=600)
    status, got = api.query_range("sum by (event_type) (last_over_time(events_value[1d]))", str(lo / 1000), str(hi / 1000), str(STEP / 1000))
    assert status == 200, got
    out = [(s["metric"]["event_type"], t * 1000, round(float(v), 6)) for s in got["data"]["result"] for t, v in s["values"]]
    return spark.createDataFrame(out, "event_type string, ts long, v double")


QUERIES |= {"json_lines": json_lines, "ordered_result": ordered_result, "limits": limits, "rollup_choice": rollup_choice, "build_info": build_info, "json_answer": json_answer}
_SHOWN = "CASE WHEN v = trunc(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END"
ORACLE_SQL["json_lines"] = f"""WITH {_SAM} SELECT '{{"metric":{{"{NAME}":"events_value","event_type":"' || event_type || '","user_id":"' || user_id || '"}},"values":[' || string_agg({_SHOWN}, ',' ORDER BY t, v) || '],"timestamps":[' || string_agg(CAST(t AS VARCHAR), ',' ORDER BY t, v) || ']}}' AS value
    FROM sam GROUP BY event_type, user_id"""
ORACLE_SQL["rollup_choice"] = f"""SELECT f, w, step, mode, f = 'max_over_time' AND mode <> 'off' AND w >= 600000 AND (mode = 'force' OR (w >= 1800000 AND 2 * step >= w)) AS used
    FROM (SELECT unnest(['max_over_time', 'stddev_over_time']) AS f), (SELECT unnest([300000, 600000, 1800000, {HOUR}])::BIGINT AS w), (SELECT unnest([60000, 1800000, {HOUR}])::BIGINT AS step), (SELECT unnest(['off', 'auto', 'force']) AS mode)"""
ORACLE_SQL["limits"] = """SELECT * FROM (VALUES ('series', 'execution', 422::BIGINT), ('samples', 'execution', 422), ('steps', 'execution', 422), ('fits', 'success', 200), ('no selector', 'bad_data', 400), ('only empty', 'bad_data', 400),
    ('bad pattern', 'bad_data', 400), ('no range', 'bad_data', 400), ('string', 'bad_data', 400), ('bad step', 'bad_data', 400)) x(name, kind, status)"""
ORACLE_SQL["build_info"] = "SELECT 'buildinfo' AS endpoint, 200::BIGINT AS status, 1::BIGINT AS n UNION ALL SELECT 'metadata', 200, 0 UNION ALL SELECT 'series', 200, count(DISTINCT (event_type, user_id)) FROM events"

ORACLE_SQL["ordered_result"] = f"{_over(_LAST6, 6 * HOUR, 0, "event_type = 'click'")} SELECT row_number() OVER (ORDER BY user_id, ts) - 1 AS place, user_id, ts, v FROM r"
ORACLE_SQL["json_answer"] = f"{_over(_LAST6, DAY)} SELECT event_type, ts, round(sum(v), 6) AS v FROM r GROUP BY ALL"
