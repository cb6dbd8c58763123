"""Range queries that read all of their tables, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tidegrid import queries, storequeries

SMALL = "/root/testdata/sf0.001"


def answers(sql: str, sf_dir: str = SMALL) -> list[tuple]:
    db = duckdb.connect()
    for t in ("events", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db.execute(sql).fetchall()


@pytest.mark.parametrize("name", ["max_ot_by_type", "offset_1d", "rollup_hybrid_count", "hist_quantile", "two_metrics", "series_list", "increase_after_resets", "rollup_aligned_max", *storequeries.QUERIES])
def test_whole_queries_match_their_sql(spark, name):
    df = (queries.QUERIES | storequeries.QUERIES)[name](spark, SMALL)
    got = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    want = answers(f"SELECT {', '.join(sorted(df.columns))} FROM ({(queries.ORACLE_SQL | storequeries.ORACLE_SQL)[name]})")
    assert got and sorted(got) == sorted(want)


def test_the_last_rows_are_read(spark):
    last_event, last_order = answers("SELECT max(epoch_ms(ts)) FROM events")[0][0], answers("SELECT max(epoch_ms(o_orderdate)) FROM orders")[0][0]
    assert max(r.ts for r in __spark_entry__.entry(spark).collect()) >= last_event
    assert max(r.ts for r in queries.QUERIES["hist_quantile"](spark, SMALL).collect()) >= last_order
    assert {r["__name__"] for r in queries.QUERIES["two_metrics"](spark, SMALL).collect()} == {"events_value", "orders_price"}
    events = answers("SELECT count(*) FROM events")[0][0]
    counted = queries.QUERIES["count_ot"](spark, SMALL).collect()
    last = max(r.ts for r in counted)
    assert sum(r.v for r in counted if (last - r.ts) % queries.DAY == 0) == events  # windows of a day, side by side
