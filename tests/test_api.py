from __future__ import annotations

import json
import random

import pytest

from tidegrid import api
from tidegrid.operators import diff, metadata
from tidegrid.plans.engine import Engine, Options

from .test_engine import T0, metric, store_of


@pytest.fixture(scope="module")
def served(spark):
    series = {metric("up", job="a", host="x"): [(T0, 1.0), (T0 + 60_000, 2.5)], metric("up", job="a", host="y"): [(T0, 0.0)], metric("down", job="b"): [(T0 + 120_000, float("inf"))]}
    return api.Api(Engine(spark, store_of(spark, series), Options(align=False)))


def seconds(ms):
    return str(ms / 1000)


def test_numbers_and_times():
    assert [api.number(v) for v in (1.0, -0.5, 1e20, 1e-7, float("nan"), float("inf"), float("-inf"), 123456789012345.0)] == ["1", "-0.5", "100000000000000000000", "0.0000001", "NaN", "+Inf", "-Inf", "123456789012345"]
    assert (api.seconds(1500), api.seconds(2000)) == (1.5, 2)
    assert api.parse_time("1.5") == 1500 and api.parse_time("1970-01-01T00:00:02Z") == 2000
    assert [api.parse_step(x) for x in ("15", "0.5", "1m", "1.5h", "500ms", "1h30m")] == [15_000, 500, 60_000, 5_400_000, 500, 5_400_000]
    for f in (api.parse_time, api.parse_step):
        with pytest.raises(api.BadData):
            f("x")


def test_matrix_vector_and_scalar(served):
    status, got = served.query_range("up", seconds(T0), seconds(T0 + 60_000), "60")
    assert status == 200 and json.dumps(got)
    assert got["data"] == {"resultType": "matrix", "result": [
        {"metric": {"__name__": "up", "host": "x", "job": "a"}, "values": [[T0 // 1000, "1"], [T0 // 1000 + 60, "2.5"]]},
        {"metric": {"__name__": "up", "host": "y", "job": "a"}, "values": [[T0 // 1000, "0"], [T0 // 1000 + 60, "0"]]},
    ]}
    assert served.query("sum(up)", seconds(T0 + 60_000))[1]["data"] == {"resultType": "vector", "result": [{"metric": {}, "value": [T0 // 1000 + 60, "2.5"]}]}
    assert served.query_range("time()", seconds(T0), seconds(T0 + 60_000), "60")[1]["data"] == {"resultType": "scalar", "result": [T0 // 1000 + 60, str(T0 // 1000 + 60)]}


def test_errors(served):
    status, got = served.query("sum(", seconds(T0))
    assert (status, got["errorType"]) == (400, "bad_data")
    limited = api.Api(Engine(served.engine.spark, served.store, Options(max_series=1)))
    assert limited.query("up", seconds(T0))[0] == 422
    assert served.series([])[0] == 400 and served.series(["up[5m]"])[0] == 400


def test_metadata(served):
    both = [{"__name__": "up", "host": "x", "job": "a"}, {"__name__": "up", "host": "y", "job": "a"}]
    assert served.series(["up", 'up{host="x"}'])[1]["data"] == both
    assert served.series(["up"], seconds(T0 + 1000), None)[1]["data"] == both[:1]
    assert served.label_names()[1]["data"] == ["__name__", "host", "job"]
    assert served.label_names(["down"])[1]["data"] == ["__name__", "job"]
    assert served.label_values("job")[1]["data"] == ["a", "b"]
    assert served.label_values("host", ["up"], None, seconds(T0))[1]["data"] == ["x", "y"]
    assert served.cardinality(9)[1]["data"] == {"headStats": {"numSeries": 3, "seriesLimit": 9}, "labelValueCountByLabelName": [{"name": n, "value": 2} for n in ("__name__", "host", "job")]}


def test_export(served):
    got = sorted(api.export(served.store, ["up", "down"]), key=lambda x: str(x["metric"]))
    assert got[1] == {"metric": {"__name__": "up", "host": "x", "job": "a"}, "values": [1, 2.5], "timestamps": [T0, T0 + 60_000]}
    assert metadata.export(served.store, ["up"], T0 + 1).count() == 1


def test_copies_are_compared_and_repaired(spark):
    r = random.Random(2)
    rows = [(sid, t * 60_000, r.choice((1.0, 0.0, -0.0, float("nan"), r.random()))) for sid in range(40) for t in range(100)]
    a = spark.createDataFrame(rows, "sid long, t long, v double")
    lost = {i for i in range(len(rows)) if rows[i][0] in (3, 17) and r.random() < 0.3}
    b = spark.createDataFrame([x for i, x in enumerate(rows) if i not in lost], "sid long, t long, v double")
    assert {(x.sid, x.t) for x in diff.missing(a, b).collect()} == {rows[i][:2] for i in lost}
    assert diff.missing(b, a).count() == 0
    assert {(x.sid, x.hour) for x in diff.differing_hours(a, b).collect()} == {(rows[i][0], rows[i][1] // 3_600_000 * 3_600_000) for i in lost}
    assert diff.repaired(a, b).count() == len(rows) and diff.differing_hours(a, diff.repaired(a, b)).count() == 0
    assert diff.differing_hours(a, a).count() == 0
