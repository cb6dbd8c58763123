"""Answers in the JSON that dashboards read. Rows are collected here and nowhere else; limits bound them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import BadData, QueryError
from .operators import metadata
from .plans.engine import Engine, Result, Store
from .plans.language import duration


def number(v: float) -> str:
    """A value as text: integers without a point, never an exponent."""
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "+Inf" if v > 0 else "-Inf"
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return format(Decimal(repr(v)), "f")


def seconds(ms: int) -> int | float:
    return ms // 1000 if ms % 1000 == 0 else ms / 1000


def parse_time(text: str) -> int:
    """Milliseconds of a Unix time in seconds, or of an RFC 3339 time."""
    from datetime import datetime

    try:
        return round(float(text) * 1000)
    except ValueError:
        pass
    try:
        return round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)
    except ValueError:
        raise BadData(f"bad time {text!r}") from None


def parse_step(text: str) -> int:
    """Milliseconds of a number of seconds, or of a duration; fractions are allowed before one unit."""
    units = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
    try:
        return round(float(text) * 1000)
    except ValueError:
        pass
    for unit, ms in units.items():
        try:
            return round(float(text.removesuffix(unit)) * ms) if text.endswith(unit) else None or duration(text)
        except (ValueError, BadData):
            continue
    raise BadData(f"bad duration {text!r}")


def labels(key: list) -> dict[str, str]:
    return {x["key"]: x["value"] for x in key}


def answer(result: Result, warnings: list[str] | None = None) -> dict:
    """A result as the object to serialize: series sorted by labels, without empty ones."""
    out: dict = {"status": "success"}
    if warnings:
        out["warnings"] = warnings
    out |= {"isPartial": False, "stats": {"rollup": result.used_rollup}}
    if result.kind == "scalar":
        # of a scalar over a range the last step counts
        last = result.frame.orderBy(F.desc("step_ts")).first()
        data: dict | list = [seconds(last["step_ts"]), number(last["v"])]
    else:
        lists = result.frame.groupBy("sid", "label_key").agg(F.array_sort(F.collect_list(F.struct("step_ts", "v"))).alias("s"))
        rows = lists.orderBy("label_key", "sid").collect()
        points = [[[seconds(p["step_ts"]), number(p["v"])] for p in r["s"]] for r in rows]
        if result.kind == "vector":
            data = [{"metric": labels(r["label_key"]), "value": p[0]} for r, p in zip(rows, points, strict=True)]
        else:
            data = [{"metric": labels(r["label_key"]), "values": p} for r, p in zip(rows, points, strict=True)]
    return out | {"data": {"resultType": result.kind, "result": data}}


def failure(e: QueryError) -> tuple[int, dict]:
    return e.status, {"status": "error", "errorType": e.kind, "error": str(e)}


class Api:
    """The query endpoints over an engine; each returns (status, object)."""

    def __init__(self, engine: Engine, timeout: float = 30.0):
        self.engine, self.timeout = engine, timeout

    @property
    def store(self) -> Store:
        return self.engine.store

    def _try(self, make) -> tuple[int, dict]:
        try:
            with self.engine.deadline(self.timeout):
                return 200, make()
        except QueryError as e:
            return failure(e)

    def query_range(self, query: str, start: str, end: str, step: str, rollup: str = "auto") -> tuple[int, dict]:
        return self._try(lambda: answer(self.engine.query_range(query, parse_time(start), parse_time(end), parse_step(step), rollup)))

    def query(self, query: str, time: str, rollup: str = "auto") -> tuple[int, dict]:
        return self._try(lambda: answer(self.engine.query(query, parse_time(time), rollup)))

    def series(self, match: list[str], start: str | None = None, end: str | None = None) -> tuple[int, dict]:
        times = [None if x is None else parse_time(x) for x in (start, end)]
        return self._try(lambda: _list([labels(r[0]) for r in metadata.series(self.store, match, *times).orderBy("label_key").collect()]))

    def label_names(self, match: list[str] | None = None, start: str | None = None, end: str | None = None) -> tuple[int, dict]:
        times = [None if x is None else parse_time(x) for x in (start, end)]
        return self._try(lambda: _list([r[0] for r in metadata.label_names(self.store, match, *times).orderBy("name").collect()]))

    def label_values(self, name: str, match: list[str] | None = None, start: str | None = None, end: str | None = None) -> tuple[int, dict]:
        times = [None if x is None else parse_time(x) for x in (start, end)]
        return self._try(lambda: _list([r[0] for r in metadata.label_values(self.store, name, match, *times).orderBy("value").collect()]))

    def cardinality(self, limit: int | None = None) -> tuple[int, dict]:
        def make() -> dict:
            top = [{"name": r["name"], "value": r["n"]} for r in metadata.cardinality(self.store).collect()]
            return {"status": "success", "data": {"headStats": {"numSeries": self.store.series.count(), "seriesLimit": limit}, "labelValueCountByLabelName": top}}

        return self._try(make)

    def metadata(self) -> tuple[int, dict]:
        return 200, {"status": "success", "data": {}}

    def build_info(self) -> tuple[int, dict]:
        return 200, {"status": "success", "data": {"version": self.engine.spark.version}}


def _list(data: list) -> dict:
    return {"status": "success", "data": data}


def export_lines(exported: DataFrame) -> DataFrame:
    """(value): a JSON line for each exported series, made on the executors."""
    shown = lambda v: F.when(v == v.cast("long"), v.cast("long").cast("string")).otherwise(v.cast("string"))
    values = F.concat(F.lit("["), F.array_join(F.transform("values", lambda v: F.when(F.isnan(v), F.lit("NaN")).when(F.abs(v) < 1e15, shown(v)).otherwise(v.cast("string"))), ","), F.lit("]"))
    metric = F.to_json(F.map_from_entries("label_key"))
    times = F.concat(F.lit("["), F.array_join(F.transform("timestamps", lambda t: t.cast("string")), ","), F.lit("]"))
    return exported.select(F.concat(F.lit('{"metric":'), metric, F.lit(',"values":'), values, F.lit(',"timestamps":'), times, F.lit("}")).alias("value"))


def export(store: Store, match: list[str], start: int | None = None, end: int | None = None) -> Iterator[dict]:
    """Exported series one by one, through the driver."""
    for r in export_lines(metadata.export(store, match, start, end)).toLocalIterator():
        yield json.loads(r["value"])
