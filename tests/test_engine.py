from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidegrid.errors import BadData, LimitExceeded, Timeout
from tidegrid.model import identified, series_of
from tidegrid.operators import rollup, windows
from tidegrid.plans.engine import Engine, Options, Store

from . import brute

T0 = 1_650_000_000_000


def store_of(spark, series, rollups=False):
    """series: {labels as a tuple of pairs: [(t, v)]}."""
    rows = [(dict(k), t, v) for k, points in series.items() for t, v in points]
    samples = identified(spark.createDataFrame(rows, "labels map<string,string>, t long, v double")).persist()
    return Store.of(samples, series_of(samples), rollup.build(samples) if rollups else None)


def points(result):
    return {(tuple((x["key"], x["value"]) for x in r["label_key"]), r["step_ts"]): r["v"] for r in result.frame.collect()}


def close(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def same(got, want):
    assert set(got) == set(want)
    assert [(k, got[k], want[k]) for k in want if not close(got[k], want[k])] == []


def metric(name, **labels):
    return tuple(sorted({"__name__": name, **labels}.items()))


@pytest.fixture(scope="module")
def noisy():
    r, out = random.Random(3), {}
    for host in "abcd":
        t, points, v = T0 + r.randrange(5000), [], 0.0
        for _ in range(150):
            t += r.choice((4000, 9000, 10_000, 31_000, 200_000))
            v = r.choice((v + r.random() * 5, v, r.random(), -r.random(), math.nan if host == "c" else 7.0, math.inf if host == "d" else 1.0))
            points.append((t, v))
        out[metric("m", host=host, region="us" if host < "c" else "eu")] = points
    return out


@pytest.fixture(scope="module")
def engine(spark, noisy):
    return Engine(spark, store_of(spark, noisy), Options(align=False))


GRID = (T0 + 100_000, T0 + 4_000_000, 60_000)


def steps(start, end, step):
    return range(start, end + 1, step)


@pytest.mark.parametrize("name", sorted(["max_over_time", "min_over_time", "sum_over_time", "avg_over_time", "count_over_time", "present_over_time", "last_over_time", "stddev_over_time", "stdvar_over_time", "irate", "rate", "increase", "delta"]))
@pytest.mark.parametrize("window, offset", [("5m", 0), ("217s", 90_000)])
def test_range_functions(engine, noisy, name, window, offset):
    w = {"5m": 300_000, "217s": 217_000}[window]
    got = points(engine.query_range(f"{name}(m[{window}]{' offset 90s' if offset else ''})", *GRID))
    keeps = name in ("max_over_time", "min_over_time", "avg_over_time", "last_over_time")
    want = {}
    for key, samples in noisy.items():
        for ts in steps(*GRID):
            v = brute.over_time(name, samples, ts - offset - w, ts - offset)
            if v is not None and not (name.startswith("std") and not all(map(math.isfinite, [x for t, x in samples if ts - offset - w < t <= ts - offset]))):
                want[tuple(p for p in key if keeps or p[0] != "__name__"), ts] = v
    got = {k: v for k, v in got.items() if k in want} if name.startswith("std") else got
    same(got, want)


@pytest.mark.parametrize("name", ["irate", "rate", "increase", "delta"])
def test_cells_of_time_change_nothing(engine, noisy, name, monkeypatch):
    monkeypatch.setattr(windows, "CELL_WINDOWS", 1)  # a cut in every window
    got = points(engine.query_range(f"{name}(m[5m])", *GRID))
    want = {(k, ts): brute.over_time(name, s, ts - 300_000, ts) for k, s in noisy.items() for ts in steps(*GRID)}
    same(got, {(tuple(p for p in k if p[0] != "__name__"), ts): v for (k, ts), v in want.items() if v is not None})


def last_values(noisy, ts, w=300_000):
    out = {k: brute.over_time("last_over_time", s, ts - w, ts) for k, s in noisy.items()}
    return {k: v for k, v in out.items() if v is not None}


@pytest.mark.parametrize("op, f", [
    ("sum", sum), ("count", lambda v: float(len(v))), ("group", lambda v: 1.0), ("avg", lambda v: sum(v) / len(v)), ("max", lambda v: brute.ignoring_nan(max, v)), ("min", lambda v: brute.ignoring_nan(min, v)),
    ("stdvar", brute.variance), ("stddev", lambda v: math.sqrt(brute.variance(v))),
])
@pytest.mark.parametrize("grouping", ["by (region)", "without (host)", ""])
def test_aggregations(engine, noisy, op, f, grouping):
    got = points(engine.query_range(f"{op} {grouping} (m)", *GRID))
    want = {}
    for ts in steps(*GRID):
        groups: dict[tuple, list[float]] = {}
        for k, v in last_values(noisy, ts).items():
            groups.setdefault(tuple(p for p in k if p[0] == "region") if grouping else (), []).append(v)
        for g, v in groups.items():
            if op.startswith("std") and not all(map(math.isfinite, v)):
                got.pop((g, ts), None)
                continue
            want[g, ts] = f(v)
    same(got, want)


def test_quantiles_and_top_k(engine, noisy):
    calm = 'm{host=~"a|b"}'
    for phi in (-1, 0, 0.3, 1, 2):
        got = points(engine.query_range(f"quantile({phi}, {calm})", *GRID))
        same(got, {((), ts): brute.quantile(phi, v) for ts in steps(*GRID) if (v := [x for k, x in last_values(noisy, ts).items() if dict(k)["host"] in "ab"])})
    got = points(engine.query_range(f"topk by (region) (1, {calm})", *GRID))
    want = {}
    for ts in steps(*GRID):
        known = sorted(((v, k) for k, v in last_values(noisy, ts).items() if dict(k)["host"] in "ab"), key=lambda x: (-x[0], x[1]))
        if known:
            want[known[0][1], ts] = known[0][0]
    same(got, want)


def test_histogram_quantile(spark):
    r, series = random.Random(5), {}
    for case in range(60):
        bounds = r.sample(["-1", "0", "1", "2.5", "5", "10", "+Inf"], r.randrange(1, 8))
        for b in bounds:
            series[metric("h", le=b, case=str(case))] = [(T0, float(r.choice((0, 0, 1, 3, 7, 12)) if case else 0))]
    e = Engine(spark, store_of(spark, series), Options())
    for phi in (-0.5, 0, 0.1, 0.5, 0.9, 1, 1.5):
        got = points(e.query(f"histogram_quantile({phi}, h)", T0))
        want = {}
        for case in range(60):
            buckets = [(float(dict(k)["le"].replace("+Inf", "inf")), s[0][1]) for k, s in series.items() if dict(k)["case"] == str(case)]
            if (v := brute.histogram_quantile(phi, buckets)) is not None:
                want[(("case", str(case)),), T0] = v
        same(got, want)


def test_a_bound_that_is_no_number_fails(spark):
    e = Engine(spark, store_of(spark, {metric("h", le="x"): [(T0, 1.0)], metric("h", le="+Inf"): [(T0, 1.0)]}), Options())
    with pytest.raises(Exception):  # noqa: B017
        e.query("histogram_quantile(0.5, h)", T0).frame.collect()


ARITHMETIC = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: a / b if b else (math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)),
    "%": lambda a, b: math.nan if b == 0 or math.isnan(a) or math.isnan(b) or math.isinf(a) else math.fmod(a, b),
    "^": lambda a, b: math.nan if a < 0 and b != int(b) else math.inf if a == 0 and b < 0 else a**b,
}
COMPARED = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
VALUES = [0.0, 1.0, -2.5, 7.0, math.nan, math.inf, -math.inf]


def test_operators_are_ieee(spark):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    series = {metric(n, i=str(i)): [(T0, p[k])] for i, p in enumerate(pairs) for k, n in enumerate("ab")}
    e = Engine(spark, store_of(spark, series), Options())
    for op, f in ARITHMETIC.items():
        if op != "^":
            same(points(e.query(f"a {op} b", T0)), {((("i", str(i)),), T0): f(*p) for i, p in enumerate(pairs)})
    same(points(e.query("a ^ 2", T0)), {((("i", str(i)),), T0): p[0] ** 2 for i, p in enumerate(pairs)})
    for op, f in COMPARED.items():
        same(points(e.query(f"a {op} bool b", T0)), {((("i", str(i)),), T0): float(f(*p)) for i, p in enumerate(pairs)})
        same(points(e.query(f"a {op} b", T0)), {(metric("a", i=str(i)), T0): p[0] for i, p in enumerate(pairs) if f(*p)})
        same(points(e.query(f"1 {op} a", T0)), {(metric("a", i=str(i)), T0): p[0] for i, p in enumerate(pairs) if f(1.0, p[0])})


def test_functions_are_ieee(spark):
    values = [*VALUES, 2.5, -0.4, 1e300, 2.0**60, 0.5]
    e = Engine(spark, store_of(spark, {metric("x", i=str(i)): [(T0, v)] for i, v in enumerate(values)}), Options())
    log = lambda f: lambda v: math.nan if math.isnan(v) or v < 0 else -math.inf if v == 0 else math.inf if v == math.inf else f(v)
    whole = lambda f: lambda v: float(f(v)) if math.isfinite(v) else v
    clamp = lambda lo, hi: lambda v: math.nan if math.isnan(v) else max(lo, min(hi, v))
    cases = {
        "abs(x)": abs, "ceil(x)": whole(math.ceil), "floor(x)": whole(math.floor), "round(x)": lambda v: whole(math.floor)(v + 0.5), "round(x, 2)": lambda v: whole(math.floor)(v / 2 + 0.5) * 2,
        "sqrt(x)": lambda v: math.nan if v < 0 or math.isnan(v) else math.sqrt(v), "ln(x)": log(math.log), "log2(x)": log(math.log2), "log10(x)": log(math.log10), "exp(x)": lambda v: math.inf if v > 700 else math.exp(v),
        "clamp(x, -1, 2)": clamp(-1, 2), "clamp_min(x, 0)": clamp(0, math.inf), "clamp_max(x, 0)": clamp(-math.inf, 0), "-x": lambda v: -v, "x + time() * 0": lambda v: v,
    }
    for text, f in cases.items():
        same(points(e.query(text, T0)), {((("i", str(i)),), T0): f(v) for i, v in enumerate(values)})


def test_alignment_and_limits(spark, engine):
    e = Engine(spark, engine.store, Options())
    g = e.grid(T0 + 1, T0 + 1 + 60 * 1000, 1000)
    assert (g.start % 1000, g.n) == (0, 61)
    assert e.grid(T0 + 1, T0 + 1 + 10_000, 1000).start == T0 + 1
    with pytest.raises(LimitExceeded):
        e.grid(0, 11_000_000, 1000)
    for options in (Options(max_series=3), Options(max_samples=10)):
        with pytest.raises(LimitExceeded):
            Engine(spark, engine.store, options).query_range("m", *GRID)
    assert Engine(spark, engine.store, Options(max_series=4)).query_range("m", *GRID).frame.count()
    for bad in ((5, 4, 1), (1, 2, 0)):
        with pytest.raises(BadData):
            e.grid(*bad)


def test_deadlines(spark, engine):
    slow = spark.range(0, 1 << 40, 1, 8).select(F.sum(F.sqrt(F.col("id") * 1.5)))
    with pytest.raises(Timeout), engine.deadline(0.3):
        slow.collect()
    with pytest.raises(Timeout), engine.deadline(0.3):  # a job that starts after the time
        time.sleep(1)
        slow.collect()
    with pytest.raises(Timeout), engine.deadline(0.1):  # no job at all
        time.sleep(0.5)
    with engine.deadline(60):
        assert spark.range(3).count() == 3


def test_increase_counts_resets_inside_the_window_only(spark):
    for big in (1000.0, 1e18, math.inf):
        store = store_of(spark, {metric("m"): [(T0 + i * 10_000, v) for i, v in enumerate((1.0, big, 1.0, 5.0, 4.0))]})
        for window, step in (("25s", 20_000), ("40s", 20_000), ("30s", 5000)):
            got = points(Engine(spark, store, Options(align=False)).query_range(f"increase(m[{window}])", T0, T0 + 40_000, step))
            w = int(window[:-1]) * 1000
            want = {((), ts): v for ts in range(T0, T0 + 40_001, step) if (v := brute.over_time("increase", [(T0 + i * 10_000, v) for i, v in enumerate((1.0, big, 1.0, 5.0, 4.0))], ts - w, ts)) is not None}
            same(got, want)


def test_matching_needs_one_right_side(spark):
    e = Engine(spark, store_of(spark, {metric("a", x="1"): [(T0, 1.0)], metric("b", x="1"): [(T0, 2.0)], metric("c", x="1"): [(T0, 3.0)]}), Options())
    same(points(e.query("a / b", T0)), {((("x", "1"),), T0): 0.5})
    with pytest.raises(Exception):  # noqa: B017
        e.query('a / {__name__=~"b|c"}', T0).frame.collect()


@pytest.mark.parametrize("name", ["max_over_time", "min_over_time", "sum_over_time", "avg_over_time", "count_over_time", "last_over_time"])
@pytest.mark.parametrize("start, step, window", [(T0, 3_600_000, "1h"), (T0 + 1234, 1_800_000, "47m"), (T0 + 37_000, 700_000, "10m")])
def test_rollups_give_the_raw_answer(spark, name, start, step, window):
    r = random.Random(6)
    series = {metric("r", host=h): [(T0 - 40_000 + i * 10_000 + r.randrange(3000), r.choice((r.gauss(0, 50), math.nan))) for i in range(2000) if r.random() > 0.05] for h in "xy"}
    store = store_of(spark, series, rollups=True)
    grid = (start, start + 6 * step, step)
    raw = Engine(spark, store, Options(align=False)).query_range(f"{name}(r[{window}])", *grid, rollup="off")
    rolled = Engine(spark, store, Options(align=False)).query_range(f"{name}(r[{window}])", *grid, rollup="force")
    assert rolled.used_rollup and not raw.used_rollup
    same(points(rolled), points(raw))
