"""Queries whose tasks must not grow with the input."""

from __future__ import annotations

import pytest

from tests.test_whole import SMALL, answers
from tidegrid import queries
from tidegrid.sources import fixtures
from tidegrid.plans import engine
from tidegrid.storage import Storage


def same_as_sql(df, sql: str) -> bool:
    got = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    return bool(got) and sorted(got) == sorted(answers(f"SELECT {', '.join(sorted(df.columns))} FROM ({sql})"))


@pytest.mark.parametrize("name", ["max_ot", "min_ot", "sum_ot", "avg_ot", "count_ot", "present_ot", "rate_q", "increase_q", "rollup_hybrid_avg"])
def test_a_large_table_has_more_tasks(spark, name, monkeypatch):
    monkeypatch.setattr(engine, "TASK_SAMPLES", 100)  # the table has a thousand samples
    df = queries.QUERIES[name](spark, SMALL)
    assert df.rdd.getNumPartitions() >= 10
    assert same_as_sql(df, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["max_ot_by_type", "topk_3", "bottomk_3", "tsbs_double_groupby_all"])
def test_grouped_queries_of_a_large_table(spark, name, monkeypatch):
    monkeypatch.setattr(engine, "TASK_SAMPLES", 100)
    df = queries.QUERIES[name](spark, SMALL)
    assert same_as_sql(df, queries.ORACLE_SQL[name])
    tasks = [int(x.split(",")[-3].strip(" )")) for x in df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("\n") if "REPARTITION_BY_NUM" in x]
    assert tasks and min(tasks) >= 10


def test_few_series_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(engine, "TASK_SAMPLES", 10)
    df = queries.QUERIES["rate_q"](spark, SMALL)
    assert df.rdd.getNumPartitions() < 50 and same_as_sql(df, queries.ORACLE_SQL["rate_q"])


def tasks_of(storage, table):
    """How many tasks wrote a table: their numbers are in the names of files."""
    files = storage.spark.read.parquet(storage._at(table)).select("_metadata.file_name").distinct().collect()
    return len({x.file_name.split("-")[1] for x in files})


def test_storage_of_a_large_table_has_more_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(engine, "TASK_SAMPLES", 60)  # 17 tasks
    storage = Storage(spark, str(tmp_path / "db"))
    rows = fixtures.EVENTS.rows(spark, SMALL).selectExpr("event_type", "user_id", "unix_millis(ts::timestamp) AS t", "value AS v", "event_id AS seq")
    storage.append(rows.select(fixtures.EVENTS.map().alias("labels"), "t", "v", "seq"), 0)
    before = sorted(map(tuple, storage.samples().collect()))
    assert tasks_of(storage, "samples") >= 12
    assert storage.series().count() == rows.select("event_type", "user_id").distinct().count()
    storage.compact()
    assert tasks_of(storage, "samples") >= 12 and tasks_of(storage, "rollup_5m") >= 12
    assert sorted(map(tuple, storage.samples().collect())) == before
    assert storage.rollups().agg({"cnt": "sum"}).first()[0] == len(before)


@pytest.mark.parametrize("name", ["rollup_hybrid_count", "rollup_hybrid_avg", "rollup_hybrid_max", "rollup_hybrid_sum"])
def test_rollups_of_a_large_table(spark, name, monkeypatch):
    monkeypatch.setattr(engine, "TASK_SAMPLES", 50)
    assert same_as_sql(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name])
