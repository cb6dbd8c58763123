"""Places of points in a result's order."""

from __future__ import annotations

from tests.test_whole import SMALL, answers
from tidegrid import storequeries
from tidegrid.operators.vectors import Grid
from tidegrid.plans.engine import Result


def test_the_order_is_made_without_the_driver(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rows were sent to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", refuse)
    df = storequeries.QUERIES["ordered_result"](spark, SMALL)
    got = [tuple(r) for r in df.select("place", "ts", "user_id", "v").collect()]
    assert got and sorted(got) == sorted(answers(f"SELECT place, ts, user_id, v FROM ({storequeries.ORACLE_SQL['ordered_result']})"))


def test_places_of_no_points(spark, tmp_path):
    none = Result("matrix", spark.createDataFrame([], "sid long, label_key array<struct<key:string,value:string>>, step_ts long, v double"), Grid(0, 1, 1))
    assert none.placed(f"file://{tmp_path}/none").collect() == []
