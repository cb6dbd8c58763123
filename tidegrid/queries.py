"""Registered queries of the metrics engine over the fixture tables, each with its SQL.

Each range query runs on a grid from the first to the last time of its tables, found by
reading them.  Sums are rounded on both sides because the order of addition is open;
counts, extremes and last values are compared exactly.
Times are floored to milliseconds (DuckDB's epoch_ms rounds).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ieee
from .model import SAMPLES, label
from .operators import admission, diff, metadata, rollup
from .plans.engine import Engine, Options, Result
from .shared import shared_dir
from .sources import fixtures
from .storage import Storage

START, STEP = 1704067200000, 21_600_000
HOUR = 3_600_000
DAY = 24 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *metrics: fixtures.Metric, rollups: DataFrame | None = None, **options) -> Engine:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Engine(spark, fixtures.store(spark, sf_dir, *(metrics or (fixtures.EVENTS,)), rollups=rollups), Options(**options))


def flat(result: Result, labels: tuple[str, ...], digits: int | None = None) -> DataFrame:
    """Labels as columns, ts and v."""
    v = F.col("v") if digits is None else ieee.round_digits(F.col("v"), digits)
    cols = [] if result.kind == "scalar" else [label(F.col("label_key"), n).alias(n) for n in labels]
    return result.frame.select(*cols, F.col("step_ts").alias("ts"), v.alias("v"))


ET, BOTH = ("event_type",), ("event_type", "user_id")
_SAM = "sam AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS t, value AS v FROM events)"


def whole(spark: SparkSession, sf_dir: str, *metrics: fixtures.Metric, start: int = START, step: int = STEP, off: int = 0) -> tuple[int, int]:
    """First and last step of the grid through start that spans all times of the metrics; off: how far the query looks back of a step."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spans = [m.rows(spark, sf_dir).select(F.unix_millis(F.col(m.time).cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t")).first() for m in metrics]
    found = [x for x in spans if x[0] is not None]
    if not found:
        return start, start
    return start + (min(x[0] for x in found) - start) // step * step, start - (start - off - max(x[1] for x in found)) // step * step


def _whole(times: str, start: int = START, step: int = STEP, off: int = 0) -> str:
    """The same grid in SQL; times: a query of all times as t."""
    span = f"SELECT CAST(floor((min(t) - {start}) / {step}) AS BIGINT) AS lo, CAST(ceil((max(t) + {off} - {start}) / {step}) AS BIGINT) AS hi FROM ({times})"
    return f"g AS (SELECT {start} + unnest(range(lo, hi + 1)) * {step} AS ts FROM ({span}))"


_TIMES = "SELECT epoch_us(ts) // 1000 AS t FROM events"
_G = _whole(_TIMES)


def _win(w: int, off: int = 0, where: str = "true", sam: str = _SAM, labels: str = "event_type, user_id") -> str:
    cols = ", ".join(f"sam.{c.strip()}" for c in labels.split(","))
    return f"WITH {_G}, {sam}, w AS (SELECT {cols}, g.ts, sam.t, sam.v FROM g JOIN sam ON sam.t > g.ts - {off + w} AND sam.t <= g.ts - {off} WHERE {where})"


def _over(agg: str, w: int, off: int = 0, where: str = "true", name: str = "r") -> str:
    return f"{_win(w, off, where)}, {name} AS (SELECT event_type, user_id, ts, {agg} AS v FROM w GROUP BY ALL)"


def add(name: str, text: str, sql: str, labels: tuple[str, ...] = BOTH, digits: int | None = None, lookback: int = 6 * HOUR, metrics: tuple = (), off: int = 0, **options) -> None:
    """Register a range query over all times of its tables; off: the offset in text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = whole(spark, sf_dir, *(metrics or (fixtures.EVENTS,)), off=off)
        return flat(engine(spark, sf_dir, *metrics, lookback=lookback, **options).query_range(text, *grid, STEP), labels, digits)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql.replace(_G, _whole(_TIMES, off=off))


def _rounded(cols: str, digits: int | None, source: str = "r") -> str:
    return f"SELECT {cols}, ts, {'v' if digits is None else f'round(v, {digits})'} AS v FROM {source}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["max_ot_by_type"](spark, sf_dir)


# --- selection

_LAST6 = "arg_max(v, t)"
for _name, _sel, _where in (
    ("sel_eq", '{event_type="click"}', "event_type = 'click'"),
    ("sel_neq", '{event_type!="click"}', "event_type <> 'click'"),
    ("sel_re", '{event_type=~"c.*|p.+",user_id=~"[0-9]"}', "regexp_full_match(event_type, 'c.*|p.+', 's') AND regexp_full_match(user_id, '[0-9]', 's')"),
    ("sel_nre", '{event_type!~"c.*",user_id!~"1.*"}', "NOT regexp_full_match(event_type, 'c.*', 's') AND NOT regexp_full_match(user_id, '1.*', 's')"),
    ("sel_missing_label", '{absent="",absent!~".+"}', "true"),
):
    add(_name, f"events_value{_sel}", _over(_LAST6, 6 * HOUR, 0, _where) + _rounded(" event_type, user_id", None))
add("instant_lookback", "events_value", _over(_LAST6, HOUR) + _rounded(" event_type, user_id", None), lookback=HOUR)
add("offset_1d", "events_value offset 1d", _over(_LAST6, 6 * HOUR, DAY) + _rounded(" event_type, user_id", None), off=DAY)

# --- functions over windows

for _name, _f, _agg, _digits in (
    ("max_ot", "max_over_time", "max(v)", None), ("min_ot", "min_over_time", "min(v)", None), ("sum_ot", "sum_over_time", "sum(v)", 6), ("avg_ot", "avg_over_time", "avg(v)", 6),
    ("count_ot", "count_over_time", "CAST(count(*) AS DOUBLE)", None), ("present_ot", "present_over_time", "CAST(1 AS DOUBLE)", None), ("last_ot", "last_over_time", "arg_max(v, t)", None),
    ("stddev_ot", "stddev_over_time", "stddev_pop(v)", 6), ("stdvar_ot", "stdvar_over_time", "var_pop(v)", 6),
):
    add(_name, f"{_f}(events_value[1d])", _over(_agg, DAY) + _rounded(" event_type, user_id", _digits), digits=_digits)
add("max_ot_unaligned", "max_over_time(events_value[7h] offset 90m)", _over("max(v)", 7 * HOUR, 90 * 60_000) + _rounded(" event_type, user_id", None), off=90 * 60_000)


def _lagged(w: int, off: int = 0) -> str:
    sam = "s0 AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS t, value AS v FROM events), sam AS (SELECT *, lag(v) OVER o AS pv, lag(t) OVER o AS pt FROM s0 WINDOW o AS (PARTITION BY event_type, user_id ORDER BY t))"
    return f"WITH {_G}, {sam}, w AS (SELECT event_type, user_id, ts, t, v, CASE WHEN pt > ts - {off + w} THEN pv END AS pv, pt FROM g JOIN sam ON t > ts - {off + w} AND t <= ts - {off})"


def _rate(w: int, counter: bool, per_second: bool, off: int = 0) -> str:
    zero = "CASE WHEN r > 0 AND v0 >= 0 AND span * (v0 / r) < head THEN span * (v0 / r) ELSE head END" if counter else "head"
    drops = "sum(CASE WHEN v < pv THEN pv ELSE 0 END)" if counter else "0"
    return f"""{_lagged(w, off)},
        a AS (SELECT event_type, user_id, ts, count(*) AS n, arg_min(v, t) AS v0, arg_max(v, t) - arg_min(v, t) + {drops} AS r, min(t) AS t0, max(t) AS t1 FROM w GROUP BY ALL HAVING count(*) > 1),
        b AS (SELECT *, (t1 - t0) / 1000.0::DOUBLE AS span, (t0 - (ts - {off + w})) / 1000.0::DOUBLE AS head, (ts - {off} - t1) / 1000.0::DOUBLE AS tail FROM a),
        c AS (SELECT *, span / (n - 1) AS gap, {zero} AS h FROM b),
        r AS (SELECT event_type, user_id, ts, r * ((span + CASE WHEN h < gap * 1.1::DOUBLE THEN h ELSE gap / 2 END + CASE WHEN tail < gap * 1.1::DOUBLE THEN tail ELSE gap / 2 END) / span){f" / {w / 1000}::DOUBLE" if per_second else ""} AS v FROM c)
        """


add("rate_q", "rate(events_value[2d])", _rate(2 * DAY, True, True) + _rounded("event_type, user_id", 12), digits=12)
add("increase_q", "increase(events_value[2d])", _rate(2 * DAY, True, False) + _rounded("event_type, user_id", 5), digits=5)
add("delta_q", "delta(events_value[50h] offset 1d)", _rate(50 * HOUR, False, False, DAY) + _rounded("event_type, user_id", 5), digits=5, off=DAY)
_BIG = fixtures.Metric("big", "events", "ts", "CASE WHEN event_id % 17 = 0 THEN 1073741824 WHEN event_id % 41 = 0 THEN double('Infinity') ELSE floor(value) END", (("event_type", "event_type"),), "event_id")
_BIG_SQL = f"""s0 AS (SELECT event_type, '' AS user_id, epoch_us(ts) // 1000 AS t, arg_min(CASE WHEN event_id % 17 = 0 THEN 1073741824 WHEN event_id % 41 = 0 THEN 'Infinity'::DOUBLE ELSE floor(value) END, event_id) AS v FROM events GROUP BY ALL), sam AS"""
for _name, _w in (("increase_after_resets", 6 * HOUR), ("increase_after_resets_unaligned", 7 * HOUR)):
    # whole numbers, so that sums do not depend on their order; a window that counts an infinite drop has no finite increase
    _inc = _rate(_w, True, False)
    add(_name, f"increase(big[{_w // HOUR}h]) < 1e300", _inc[: _inc.index("s0 AS")] + _BIG_SQL + _inc[_inc.index("sam AS") + 6 :] + "SELECT event_type, ts, round(v, 4) AS v FROM r WHERE v < 1e300", ET, 4, metrics=(_BIG,))
add(
    "irate_q", "irate(events_value[2d])",
    f"{_lagged(2 * DAY)}, a AS (SELECT event_type, user_id, ts, arg_max(v, t) AS v, max(t) AS t1, arg_max({{'p': pv, 't': pt}}, t) AS p FROM w GROUP BY ALL), r AS (SELECT event_type, user_id, ts, (CASE WHEN v < p.p THEN v ELSE v - p.p END) / ((t1 - p.t) / 1000.0::DOUBLE) AS v FROM a WHERE p.p IS NOT NULL) " + _rounded("event_type, user_id", 9),
    digits=9,
)

# --- aggregation across series

_L = _over(_LAST6, DAY)
_LAST = "last_over_time(events_value[1d])"
add("max_ot_by_type", "max by (event_type) (max_over_time(events_value[24h]))", f"{_win(DAY)} SELECT event_type, ts, max(v) AS v FROM w GROUP BY ALL", ET)
for _name, _text, _agg, _digits in (
    ("sum_by", "sum by (event_type) ({})", "sum(v)", 6), ("avg_by", "avg by (event_type) ({})", "avg(v)", 6), ("count_by", "count by (event_type) ({})", "CAST(count(*) AS DOUBLE)", None), ("group_by", "group by (event_type) ({})", "CAST(1 AS DOUBLE)", None),
    ("max_without", "max without (user_id) ({})", "max(v)", None), ("min_by", "min({}) by (event_type,)", "min(v)", None), ("stddev_by", "stddev by (event_type) ({})", "stddev_pop(v)", 6), ("stdvar_by", "stdvar by (event_type) ({})", "var_pop(v)", 6),
    ("quantile_09", "quantile by (event_type) (0.9, {})", "quantile_cont(v, 0.9)", 6),
):
    add(_name, _text.format(_LAST), f"{_L} SELECT event_type, ts, {_agg if _digits is None else f'round({_agg}, {_digits})'} AS v FROM r GROUP BY ALL", ET, _digits)
add("sum_all", f"sum({_LAST})", f"{_L} SELECT ts, round(sum(v), 6) AS v FROM r GROUP BY ALL", (), 6)
add("quantile_out", f"quantile by (event_type) (1.5, {_LAST})", f"{_L} SELECT DISTINCT event_type, ts, CAST('Infinity' AS DOUBLE) AS v FROM r", ET)
add("by_name", f"count by (__name__) ({_LAST})", f"{_L} SELECT 'events_value' AS __name__, ts, CAST(count(*) AS DOUBLE) AS v FROM r GROUP BY ALL", ("__name__",))
for _name, _order in (("topk_3", "DESC"), ("bottomk_3", "ASC")):
    add(_name, f"{_name[:-2]}(3, {_LAST}) by (event_type)", f"{_L} SELECT event_type, user_id, ts, v FROM r QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY v {_order}, user_id) <= 3")

# --- operators

add("vec_scalar_arith", f"2 * {_LAST} + 1", f"{_L} SELECT event_type, user_id, ts, 2 * v + 1 AS v FROM r")
add("mod_pow", f"({_LAST} % 7) ^ 2", f"{_L} SELECT event_type, user_id, ts, round(pow(v % 7, 2), 6) AS v FROM r", digits=6)
add("unary_minus", f"-{_LAST}", f"{_L} SELECT event_type, user_id, ts, -v AS v FROM r")
add("cmp_filter", f"{_LAST} > 50", f"{_L} SELECT event_type, user_id, ts, v FROM r WHERE v > 50")
add("cmp_bool", f"{_LAST} <= bool 50", f"{_L} SELECT event_type, user_id, ts, CASE WHEN v <= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM r")
add("div_zero", f"{_LAST} / 0", f"{_L} SELECT event_type, user_id, ts, CASE WHEN v > 0 THEN CAST('Infinity' AS DOUBLE) WHEN v < 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END AS v FROM r")
_TWO = f"{_over('max(v)', DAY)}, m AS (SELECT event_type, user_id, ts, min(v) AS lo FROM w GROUP BY ALL)"
add("vec_vec_div", "max_over_time(events_value[1d]) / min_over_time(events_value[1d])", f"{_TWO} SELECT event_type, user_id, ts, round(CASE WHEN lo = 0 THEN v * CAST('Infinity' AS DOUBLE) ELSE v / lo END, 6) AS v FROM r JOIN m USING (event_type, user_id, ts)", digits=6)
add("vec_vec_filter", "max_over_time(events_value[1d]) > min_over_time(events_value[1d])", f"{_TWO} SELECT event_type, user_id, ts, v FROM r JOIN m USING (event_type, user_id, ts) WHERE v > lo")
add("scalar_scalar", "2 ^ 3 ^ 2 - -2 ^ 2 + 7 % 4 > bool 500", f"WITH {_G} SELECT ts, 1.0::DOUBLE AS v FROM g", ())

# --- functions of vectors and scalars

for _name, _text, _sql, _digits in (
    ("abs_q", "abs({} - 50)", "abs(v - 50)", 9), ("ceil_q", "ceil({})", "ceil(v)", None), ("floor_q", "floor({})", "floor(v)", None), ("round_to", "round({} - 60, 5)", "floor((v - 60) / 5 + 0.5::DOUBLE) * 5", None),
    ("sqrt_q", "sqrt({})", "sqrt(v)", 6), ("exp_q", "exp({} / 100)", "exp(v / 100)", 6), ("clamp_q", "clamp({}, 20, 60)", "least(greatest(v, 20), 60)", None), ("clamp_min_q", "clamp_min({}, 30)", "greatest(v, 30)", None), ("clamp_max_q", "clamp_max({}, 30)", "least(v, 30)", None),
    ("ln_q", "ln({})", "CASE WHEN v = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE ln(v) END", 6), ("log2_q", "log2({})", "CASE WHEN v = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE log2(v) END", 6), ("log10_q", "log10({})", "CASE WHEN v = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE log10(v) END", 6),
):
    add(_name, _text.format(_LAST), f"{_L} SELECT event_type, user_id, ts, {_sql if _digits is None else f'round({_sql}, {_digits})'} AS v FROM r", digits=_digits)
add("time_q", "time() * 2", f"WITH {_G} SELECT ts, ts / 1000.0::DOUBLE * 2 AS v FROM g", ())
add("vector_q", "vector(time() + 1)", f"WITH {_G} SELECT ts, ts / 1000.0::DOUBLE + 1 AS v FROM g", ())
_ONE = f"{_over(_LAST6, DAY, 0, "event_type = 'click' AND user_id = '1'")}"
add("scalar_q", 'scalar(last_over_time(events_value{event_type="click",user_id="1"}[1d])) + 1', f"{_ONE} SELECT ts, coalesce(v + 1, CAST('NaN' AS DOUBLE)) AS v FROM g LEFT JOIN r USING (ts)", ())
add("topk_varying", f"topk(scalar(count({_LAST})) % 3, {_LAST})", f"{_L} SELECT event_type, user_id, ts, v FROM r QUALIFY row_number() OVER (PARTITION BY ts ORDER BY v DESC, event_type, user_id) <= count(*) OVER (PARTITION BY ts) % 3")


# --- histograms: order prices counted into buckets

BOUNDS = (50_000, 100_000, 200_000, 300_000)


def _half_years(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """Median order price of each priority, from cumulative buckets of half-years."""
    from .model import identified, series_of
    from .plans.engine import Store

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("p"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"), F.col("o_totalprice").alias("x"))
    bounds = F.array(*[F.lit(str(b)) for b in BOUNDS], F.lit("+Inf"))
    t = F.col("t") + F.pmod(-F.col("t"), F.lit(180 * DAY))
    counted = rows.groupBy("p", t.alias("t")).agg(*[F.count_if(F.col("x") <= b).cast("double").alias(f"b{b}") for b in BOUNDS], F.count("*").cast("double").alias("all"))
    both = counted.select("p", "t", F.explode(F.arrays_zip(bounds.alias("le"), F.array(*[f"b{b}" for b in BOUNDS], "all").alias("v"))).alias("z")).select("p", "t", "z.le", "z.v")
    samples = identified(both.select("t", "v", F.create_map(F.lit("__name__"), F.lit("price_bucket"), F.lit("priority"), F.col("p"), F.lit("le"), F.col("le")).alias("labels")))
    out = Engine(spark, Store.of(samples, series_of(samples)), Options(align=False)).query_range("histogram_quantile(0.5, price_bucket)", first, last, 180 * DAY)
    return flat(out, ("priority",), 6)


QUERIES["hist_quantile"] = lambda spark, sf_dir: _half_years(spark, sf_dir, *whole(spark, sf_dir, fixtures.ORDERS, start=0, step=180 * DAY))
ORACLE_SQL["hist_quantile"] = f"""
    WITH o AS (SELECT o_orderpriority AS priority, (epoch_us(o_orderdate) // 1000) AS t, o_totalprice AS x FROM orders),
    b AS (SELECT priority, t + (({180 * DAY} - t % {180 * DAY}) % {180 * DAY}) AS ts, x FROM o),
    le AS (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in BOUNDS)}, 'Infinity'::DOUBLE]) AS le),
    c AS (SELECT priority, ts, le, CAST(sum(CASE WHEN x <= le THEN 1 ELSE 0 END) AS DOUBLE) AS m FROM b, le GROUP BY ALL),
    d AS (SELECT *, lag(le, 1, 0) OVER o AS pl, lag(m, 1, 0) OVER o AS pm, max(m) OVER (PARTITION BY priority, ts) AS tot FROM c WINDOW o AS (PARTITION BY priority, ts ORDER BY le)),
    e AS (SELECT * FROM d WHERE m >= 0.5 * tot QUALIFY row_number() OVER (PARTITION BY priority, ts ORDER BY le) = 1)
    SELECT priority, ts, round(CASE WHEN le = 'Infinity' THEN pl ELSE pl + (le - pl) * ((0.5 * tot - pm) / (m - pm)) END, 6) AS v FROM e"""

# --- rollups


def _events_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return rollup.build(fixtures.EVENTS.samples(spark, sf_dir))


def rollup_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = _events_rollups(spark, sf_dir).join(fixtures.EVENTS.series(spark, sf_dir), "sid")
    return rolled.select(*[label(F.col("label_key"), n).alias(n) for n in BOTH], "e", "mn", "mx", F.round("sm", 6).alias("sm"), "cnt", "la")


QUERIES["rollup_build"] = rollup_build
ORACLE_SQL["rollup_build"] = f"WITH {_SAM} SELECT event_type, user_id, t + ((300000 - t % 300000) % 300000) AS e, min(v) AS mn, max(v) AS mx, round(sum(v), 6) AS sm, count(*) AS cnt, arg_max(v, t) AS la FROM sam GROUP BY ALL"


def _stored_events(spark: SparkSession, sf_dir: str) -> Storage:
    """Events written, compacted and rolled up in a store of their own."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    storage = Storage(spark, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")
    storage.append(rows.select(fixtures.EVENTS.map().alias("labels"), t.alias("t"), F.col("value").alias("v"), F.col("event_id").alias("seq")), 0)
    storage.compact()
    return storage


def _hybrid(name: str, text: str, sql: str, digits: int | None = None, start: int = START + 1234) -> None:
    """From stored rollups: raw samples are read at the edges of windows alone, on a grid of whole buckets not at all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _stored_events(spark, sf_dir).store()
        if start % rollup.RESOLUTION == 0:
            store.scan = lambda lo, hi: spark.createDataFrame([], SAMPLES).select(F.raise_error(F.lit("raw samples were read")).cast("long").alias("sid"), "t", "v")
        grid = whole(spark, sf_dir, fixtures.EVENTS, start=start)
        return flat(Engine(spark, store, Options(rollup="force", align=False)).query_range(text, *grid, STEP), BOTH, digits)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql.replace(_G, _whole(_TIMES, start))


_hybrid("rollup_hybrid_max", "max_over_time(events_value[1d])", _over("max(v)", DAY) + _rounded(" event_type, user_id", None))
_hybrid("rollup_hybrid_last", "last_over_time(events_value[1d])", _over("arg_max(v, t)", DAY) + _rounded(" event_type, user_id", None))
_hybrid("rollup_hybrid_avg", "avg_over_time(events_value[1d])", _over("avg(v)", DAY) + _rounded(" event_type, user_id", 6), 6)
_hybrid("rollup_hybrid_sum", "sum_over_time(events_value[1d])", _over("sum(v)", DAY) + _rounded(" event_type, user_id", 6), 6)
_hybrid("rollup_hybrid_count", "count_over_time(events_value[1d])", _over("CAST(count(*) AS DOUBLE)", DAY) + _rounded(" event_type, user_id", None))

_hybrid("rollup_aligned_max", "max_over_time(events_value[1d])", _over("max(v)", DAY) + _rounded(" event_type, user_id", None), start=START)

# --- shapes of the benchmark: few series over short windows, all series, double grouping

# Ten metrics of hosts: five event types, by value and by the number in their properties.  The table has about a
# sample a host, metric and two days, so windows of 6 h stand for the benchmark's minutes.
_HOSTS = """sam AS (SELECT 'usage_' || event_type AS name, CAST(user_id AS VARCHAR) AS hostname, epoch_us(ts) // 1000 AS t, value AS v FROM events
    UNION ALL SELECT 'depth_' || event_type, CAST(user_id AS VARCHAR), epoch_us(ts) // 1000, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) FROM events)"""
_CPU = (fixtures.USAGE, fixtures.DEPTH)
_ONE_METRIC, _FIVE, _TEN = ("usage_click", "name = 'usage_click'"), ("usage_.*", "name LIKE 'usage_%'"), ("usage_.*|depth_.*", "true")
_HOST, _EIGHT = ("1", "hostname = '1'"), ("[1-8]", "regexp_full_match(hostname, '[1-8]')")
for _name, _metric, _who, _w in (
    ("tsbs_single_groupby_1_1_1", _ONE_METRIC, _HOST, 6), ("tsbs_single_groupby_1_1_12", _ONE_METRIC, _HOST, 12), ("tsbs_single_groupby_1_8_1", _ONE_METRIC, _EIGHT, 6), ("tsbs_single_groupby_5_1_1", _FIVE, _HOST, 6),
    ("tsbs_single_groupby_5_1_12", _FIVE, _HOST, 12), ("tsbs_single_groupby_5_8_1", _FIVE, _EIGHT, 6), ("tsbs_cpu_max_all_1", _TEN, _HOST, 8), ("tsbs_cpu_max_all_8", _TEN, _EIGHT, 8),
):
    _text = f'max by (__name__) (max_over_time({{__name__=~"{_metric[0]}",hostname=~"{_who[0]}"}}[{_w}h]))'
    _sql = _win(_w * HOUR, 0, f"{_metric[1]} AND {_who[1]}", _HOSTS, "name, hostname") + " SELECT name AS __name__, ts, max(v) AS v FROM w GROUP BY ALL"
    add(_name, _text, _sql, ("__name__",), metrics=_CPU[: 2 if _metric is _TEN else 1])
for _name, _metric in (("tsbs_double_groupby_1", _ONE_METRIC), ("tsbs_double_groupby_5", _FIVE), ("tsbs_double_groupby_all", _TEN)):
    _sql = _win(6 * HOUR, 0, _metric[1], _HOSTS, "name, hostname") + ", r AS (SELECT name AS __name__, hostname, ts, avg(v) AS v FROM w GROUP BY ALL) " + _rounded("__name__, hostname", 6)
    add(_name, f'avg by (__name__, hostname) (avg_over_time({{__name__=~"{_metric[0]}"}}[6h]))', _sql, ("__name__", "hostname"), 6, metrics=_CPU[: 2 if _metric is _TEN else 1])


def two_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with a sample of either metric, by months from the first order to the last event."""
    both = (fixtures.EVENTS, fixtures.ORDERS)
    grid = whole(spark, sf_dir, *both, start=0, step=30 * DAY)
    return flat(engine(spark, sf_dir, *both).query_range("count by (__name__) (last_over_time({__name__=~'events_.*|orders_.*'}[30d]))", *grid, 30 * DAY), ("__name__",))


QUERIES["two_metrics"] = two_metrics
ORACLE_SQL["two_metrics"] = f"""WITH {_whole(f"{_TIMES} UNION ALL SELECT epoch_us(o_orderdate) // 1000 FROM orders", 0, 30 * DAY)}, s AS (SELECT 'events_value' AS n, event_type || '/' || user_id AS k, (epoch_us(ts) // 1000) AS t FROM events UNION ALL SELECT 'orders_price', o_orderpriority || '/' || o_orderstatus, (epoch_us(o_orderdate) // 1000) FROM orders)
    SELECT n AS __name__, ts, CAST(count(DISTINCT k) AS DOUBLE) AS v FROM g JOIN s ON t > ts - {30 * DAY} AND t <= ts GROUP BY ALL"""

# --- admission of arrivals: events by a scrambled order of their ids

_ORDER = "(event_id * 7919) % 10007"
_WINDOW = 12 * HOUR


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    # times cut to hours, so that some repeat
    return rows.select("event_type", (F.col("user_id") % 10).alias("user"), "event_id", F.xxhash64("event_type", F.col("user_id") % 10).alias("sid"), (t - F.pmod(t, F.lit(HOUR))).alias("t"), F.expr(_ORDER).alias("seq"))


def admission_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every event is judged when events arrive in another order."""
    judged = admission.classify(_arrivals(spark, sf_dir), _WINDOW, START + DAY, ("seq", "event_id"))
    return judged.select("event_id", "verdict")


_JUDGED = f"""WITH a AS (SELECT event_id, event_type AS k, user_id % 10 AS u, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS t, {_ORDER} AS seq FROM events),
    b AS (SELECT *, max(CASE WHEN t >= {START + DAY} THEN t END) OVER (PARTITION BY k, u ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
          row_number() OVER (PARTITION BY k, u, t ORDER BY seq, event_id) AS nth FROM a),
    c AS (SELECT event_id, CASE WHEN t < {START + DAY} THEN 'too_old' WHEN top IS NULL OR t > top THEN 'ok' WHEN t = top THEN 'duplicate' WHEN t < top - {_WINDOW} THEN 'too_old' WHEN nth > 1 THEN 'duplicate' ELSE 'late' END AS verdict FROM b)"""
QUERIES["admission_classes"] = admission_classes
ORACLE_SQL["admission_classes"] = f"{_JUDGED} SELECT event_id, verdict FROM c"
QUERIES["admission_counters"] = lambda spark, sf_dir: admission.counters(admission_classes(spark, sf_dir))
ORACLE_SQL["admission_counters"] = f"{_JUDGED} SELECT verdict, count(*) AS n FROM c GROUP BY ALL"

# --- series and labels

_STORES = (fixtures.EVENTS, fixtures.ORDERS)
_PAIRS = """p AS (SELECT '__name__' AS k, 'events_value' AS v UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT '__name__', 'orders_price' UNION ALL SELECT 'priority', o_orderpriority FROM orders UNION ALL SELECT 'status', o_orderstatus FROM orders)"""


def _stored(spark: SparkSession, sf_dir: str):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return fixtures.store(spark, sf_dir, *_STORES)


def series_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of two overlapping selectors with a sample between the first and the last time."""
    found = metadata.series(_stored(spark, sf_dir), ['{event_type="click"}', '{event_type=~"c.*|p.*"}'], *whole(spark, sf_dir, fixtures.EVENTS))
    return found.select(*[label(F.col("label_key"), n).alias(n) for n in BOTH])


QUERIES["series_list"] = series_list
ORACLE_SQL["series_list"] = "SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE regexp_full_match(event_type, 'c.*|p.*')"
QUERIES["label_names"] = lambda spark, sf_dir: metadata.label_names(_stored(spark, sf_dir))
ORACLE_SQL["label_names"] = f"WITH {_PAIRS} SELECT DISTINCT k AS name FROM p"
QUERIES["label_values"] = lambda spark, sf_dir: metadata.label_values(_stored(spark, sf_dir), "user_id", ['{event_type="click"}'])
ORACLE_SQL["label_values"] = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click'"
QUERIES["cardinality"] = lambda spark, sf_dir: metadata.cardinality(_stored(spark, sf_dir))
ORACLE_SQL["cardinality"] = f"WITH {_PAIRS} SELECT k AS name, count(DISTINCT v) AS n FROM p GROUP BY ALL ORDER BY n DESC, name LIMIT 10"


def export_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples of every event series, as lists in time order."""
    out = metadata.export(_stored(spark, sf_dir), ["events_value"])
    return out.select(*[label(F.col("label_key"), n).alias(n) for n in BOTH], F.size("values").cast("long").alias("n"), F.array_join(F.col("timestamps").cast("array<string>"), ",").alias("times"), F.array_join(F.transform("values", lambda v: (v * 100).cast("long").cast("string")), ",").alias("cents"))


QUERIES["export_samples"] = export_samples
ORACLE_SQL["export_samples"] = f"WITH {_SAM} SELECT event_type, user_id, count(*) AS n, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t, v) AS times, string_agg(CAST(CAST(trunc(v * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY t, v) AS cents FROM sam GROUP BY ALL"

# --- two copies of the samples, one of which lacks some and is repaired


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    a = fixtures.EVENTS.samples(spark, sf_dir)
    return a, a.filter("t % 11 <> 3")


def replica_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second copy lacks."""
    lost = diff.missing(*_copies(spark, sf_dir)).join(fixtures.EVENTS.series(spark, sf_dir), "sid")
    return lost.select(*[label(F.col("label_key"), n).alias(n) for n in BOTH], "t", "v")


QUERIES["replica_diff"] = replica_diff
ORACLE_SQL["replica_diff"] = f"WITH {_SAM} SELECT event_type, user_id, t, v FROM sam WHERE t % 11 = 3"
QUERIES["replica_repair"] = lambda spark, sf_dir: diff.repaired(*_copies(spark, sf_dir)).groupBy("t").agg(F.count("*").alias("n"), F.max("v").alias("v"))
ORACLE_SQL["replica_repair"] = f"WITH {_SAM} SELECT t, count(*) AS n, max(v) AS v FROM sam GROUP BY ALL"

# --- formats: events written as lines and read again


def line_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each series, from line protocol."""
    from .sources import lineprotocol

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = rows.select(F.concat(F.lit("events,event_type="), "event_type", F.lit(",user_id="), F.col("user_id").cast("string"), F.lit(" value="), F.col("value").cast("string"), F.lit(' ,note="x" '.strip()), F.lit(" "), F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("value"))
    back = lineprotocol.parse(lines, "ms", START).filter("error is null and labels is not null")
    return back.groupBy(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id")).agg(F.max_by("v", "t").alias("v"), F.count("*").alias("n"), F.sum("skipped").alias("skipped"))


QUERIES["line_round_trip"] = line_round_trip
ORACLE_SQL["line_round_trip"] = f"WITH {_SAM} SELECT event_type, user_id, arg_max(v, t) AS v, count(*) AS n, count(*) AS skipped FROM sam GROUP BY ALL"


def exposition_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples a series, from the text format, with a label that lines lack."""
    from .sources import exposition

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = rows.select(F.format_string('events_value{event_type="%s",user_id="%s"} %s %s', "event_type", F.col("user_id").cast("string"), F.col("value").cast("string"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("value"))
    back = exposition.parse(lines, START, {"job": "fixture"})
    return back.groupBy(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["job"].alias("job")).agg(F.max("v").alias("v"), F.min("t").alias("t"), F.count("*").alias("n"))


QUERIES["exposition_round_trip"] = exposition_round_trip
ORACLE_SQL["exposition_round_trip"] = f"WITH {_SAM} SELECT event_type, 'fixture' AS job, max(v) AS v, min(t) AS t, count(*) AS n FROM sam GROUP BY ALL"
