"""From query text to DataFrames: alignment, limits, the choice of rollups, evaluation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadData, LimitExceeded, Timeout
from ..operators import aggregate, binary, functions, rollup, windows
from ..operators.select import select_series
from ..operators.vectors import Grid, Scalar, Vector
from . import language as q

ROLLUP_MODES = {"off": "off", "0": "off", "false": "off", "force": "force", "on": "force", "1": "force", "true": "force", "auto": "auto", "": "auto"}


@dataclass
class Options:
    lookback: int = 300_000
    max_steps: int = 11_000
    max_series: int | None = None
    max_samples: int | None = None
    align: bool = True
    rollup: str = "auto"


@dataclass
class Store:
    """Where samples and series come from.

    ``scan(lo, hi)`` gives samples (sid, t, v) with lo <= t <= hi, so that a source can push
    the range into its files; ``rollups`` is (sid, e, mn, mx, sm, cnt, la) or None.
    ``size()`` gives the number of samples and about that of series, both of the whole source;
    without it, Spark alone decides how many tasks a query has.
    """

    series: DataFrame
    scan: Callable[[int, int], DataFrame]
    rollups: DataFrame | None = None
    size: Callable[[], tuple[int, int]] | None = None

    @classmethod
    def of(cls, samples: DataFrame, series: DataFrame, rollups: DataFrame | None = None) -> Store:
        return cls(series, lambda lo, hi: samples.filter(F.col("t").between(lo, hi)).select("sid", "t", "v"), rollups)


@dataclass
class Result:
    """A vector's (sid, label_key, step_ts, v), or a scalar's (step_ts, v); unordered, not yet computed."""

    kind: str
    frame: DataFrame
    grid: Grid
    used_rollup: bool = False
    series: DataFrame | None = None

    def ordered(self) -> DataFrame:
        return self.frame.orderBy("label_key", "sid", "step_ts") if self.kind != "scalar" else self.frame.orderBy("step_ts")

    def placed(self, path: str) -> DataFrame:
        """The points with their ``place`` in the order, from 0 on.

        The sorted points are stored at path with their part of the order and their number in it, since another
        sort may cut elsewhere; only a count of each part reaches the driver.
        """
        nth = F.monotonically_increasing_id()
        self.ordered().withColumn("_nth", nth).write.parquet(path)
        stored = self.frame.sparkSession.read.parquet(path)
        part = F.shiftright("_nth", 33)
        before, starts = 0, []
        for p, n in sorted(map(tuple, stored.groupBy(part).count().collect())):
            starts.append((p, before - (p << 33)))
            before += n
        shift = self.frame.sparkSession.createDataFrame(starts, "_part long, _shift long")
        return stored.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn("place", F.col("_nth") + F.col("_shift")).drop("_nth", "_part", "_shift")


@dataclass
class Engine:
    spark: SparkSession
    store: Store
    options: Options = field(default_factory=Options)

    def grid(self, start: int, end: int, step: int) -> Grid:
        if step <= 0:
            raise BadData("step must be positive")
        if end < start:
            raise BadData("end is before start")
        if self.options.align and end - start >= 50 * step:
            points = (end - start) // step + 1
            start -= start % step
            end += -end % step
            if (end - start) // step + 1 != points:
                end -= step
        n = (end - start) // step + 1
        if n > self.options.max_steps:
            raise LimitExceeded(f"{n} steps are more than the limit of {self.options.max_steps}")
        return Grid(start, step, n)

    def query_range(self, text: str, start: int, end: int, step: int, rollup: str | None = None) -> Result:
        return Evaluation(self, self.grid(start, end, step), rollup or self.options.rollup).run(q.parse(text), "matrix")

    def query(self, text: str, at: int, rollup: str | None = None) -> Result:
        """An instant query: a grid of one step."""
        return Evaluation(self, Grid(at, 1000, 1), rollup or self.options.rollup).run(q.parse(text), "vector")

    @contextmanager
    def deadline(self, seconds: float) -> Iterator[None]:
        """Jobs inside are cancelled after so many seconds, later ones too, and Timeout is raised at the latest on leaving."""
        context = self.spark.sparkContext
        tag, fired, left = f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        context.addJobTag(tag)

        def watch() -> None:
            if left.wait(seconds):
                return
            fired.set()
            while True:  # a job may start after any one cancellation
                context.cancelJobsWithTag(tag)
                if left.wait(0.1):
                    return

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        except Exception as e:
            if fired.is_set():
                raise Timeout(f"no answer within {seconds} s") from e
            raise
        finally:
            left.set()
            watcher.join()
            context.removeJobTag(tag)
        if fired.is_set():
            raise Timeout(f"no answer within {seconds} s")


#: Samples to a task: its hash tables and sorts hold the steps of so many samples, however many there are in all.
TASK_SAMPLES = 100_000


class Evaluation:
    def __init__(self, engine: Engine, grid: Grid, mode: str):
        if mode not in ROLLUP_MODES:
            raise BadData(f"unknown rollup mode {mode!r}")
        self.spark, self.store, self.options, self.grid, self.mode = engine.spark, engine.store, engine.options, grid, ROLLUP_MODES[mode]
        self.used_rollup = False
        self.charged: set[tuple] = set()
        self.tasks: int | None = None

    def run(self, tree: object, kind: str) -> Result:
        out = self.eval(tree)
        if isinstance(out, Scalar):
            steps = self.grid.frame(self.spark).select("step_ts", out.column.alias("v")) if out.frame is None else out.frame.select("step_ts", F.col("s").alias("v"))
            return Result("scalar", steps, self.grid, self.used_rollup)
        return Result(kind, out.labelled(), self.grid, self.used_rollup, out.series)

    def eval(self, x: object) -> Scalar | Vector:
        if isinstance(x, q.Number):
            return Scalar.of(x.value)
        if isinstance(x, q.Text):
            raise BadData("a string is not a value")
        if isinstance(x, q.Selector):
            if x.range is not None:
                raise BadData("a range selector needs a range function")
            return self.windowed("last_over_time", x, self.options.lookback, self.scan(x, self.options.lookback), keep_name=True)
        if isinstance(x, q.Unary):
            of = self.eval(x.of)
            return of.map(lambda v: -v) if isinstance(of, Vector) else binary.scalars(self.spark, self.grid, lambda v: -v, of)
        if isinstance(x, q.Binary):
            return binary.apply(self.spark, self.grid, x.op, x.as_bool, self.eval(x.left), self.eval(x.right))
        if isinstance(x, q.Aggregate):
            of = self.eval(x.of)
            parameter = None if x.parameter is None else self.eval(x.parameter)
            if not isinstance(of, Vector) or isinstance(parameter, Vector):
                raise BadData(f"{x.op} aggregates a vector" + " by a scalar parameter" * (parameter is not None))
            return aggregate.aggregate(of, x.op, x.by, x.without, parameter)
        if x.name in q.RANGE:
            s = x.args[0]
            keep = x.name in q.KEEPS_NAME
            if self.store.rollups is not None and rollup.applies(x.name, s.range, self.grid, self.mode):
                return self.from_rollups(x.name, s, keep)
            return self.windowed(x.name, s, s.range, self.scan(s, s.range), keep)
        return functions.call(self.spark, self.grid, x.name, [self.eval(a) for a in x.args])

    def bounds(self, s: q.Selector, window: int) -> tuple[int, int]:
        return self.grid.start - s.offset - window + 1, self.grid.end - s.offset

    def scan(self, s: q.Selector, window: int) -> tuple[DataFrame, DataFrame]:
        """(samples, series) of a selector over the grid: labels are matched in the small table, which then restricts the samples."""
        series = select_series(self.store.series, s.matchers)
        lo, hi = self.bounds(s, window)
        samples = self.selected(self.store.scan(lo, hi), series)
        self.charge(s, window, series, samples)
        return samples, series

    def selected(self, rows: DataFrame, series: DataFrame) -> DataFrame:
        """Rows of these series; of a large source by series, in as many tasks as there are TASK_SAMPLES.

        All that follows up to the labels is grouped by series, so it runs in these tasks.  Left alone, Spark makes as
        few as there are cores, and each grows with the input.  Few series make few groups, and would make long tasks:
        they are left alone.
        """
        ids = series.select("sid")
        if self.tasks is None:
            samples, known = self.store.size() if self.store.size is not None else (0, 0)
            # more than Spark's own: with fewer the join with labels would move all points again, and with as many
            # Spark would keep the partitions that the ids have, and merge them
            tasks = max(-(-samples // TASK_SAMPLES), int(self.spark.conf.get("spark.sql.shuffle.partitions")) + 1)
            self.tasks = tasks if samples > TASK_SAMPLES * self.spark.sparkContext.defaultParallelism and known >= 4 * tasks else 0
        if self.tasks:
            # the join moves the rows to where the ids are: they travel once
            ids = ids.repartition(self.tasks, "sid").hint("shuffle_hash")
        return rows.join(ids, "sid", "left_semi")

    def charge(self, s: q.Selector, window: int, series: DataFrame, samples: DataFrame) -> None:
        """Limits are counted once for each distinct selection, by jobs over the dimension and the pruned scan."""
        key = (s.matchers, s.offset, window)
        if key in self.charged:
            return
        self.charged.add(key)
        if self.options.max_series is not None:
            most = self.options.max_series
            if series.limit(most + 1).count() > most:
                raise LimitExceeded(f"the query selects more than {most} series")
        if self.options.max_samples is not None:
            most = self.options.max_samples
            if samples.limit(most + 1).count() > most:
                raise LimitExceeded(f"the query reads more than {most} samples")

    def windowed(self, name: str, s: q.Selector, window: int, found: tuple[DataFrame, DataFrame], keep_name: bool) -> Vector:
        samples, series = found
        out = Vector(windows.over_time(samples, name, window, s.offset, self.grid), series)
        return out if keep_name else out.nameless()

    def from_rollups(self, name: str, s: q.Selector, keep_name: bool) -> Vector:
        """Buckets, and raw samples of the windows' edges alone; on a grid of whole buckets no raw sample is read."""
        series = select_series(self.store.series, s.matchers)
        lo, hi = self.bounds(s, s.range)
        edges = rollup.edges(s.range, s.offset, self.grid)
        raw = None
        if edges:
            held = self.store.scan(lo, hi).filter(reduce(or_, [F.col("t").between(a, b) for a, b in edges]))
            raw = self.selected(held, series)
            self.charge(s, s.range, series, raw)
        buckets = self.selected(self.store.rollups.filter(F.col("e").between(lo, hi)), series)
        self.used_rollup = True
        out = Vector(rollup.over_time(raw, buckets, name, s.range, s.offset, self.grid), series)
        return out if keep_name else out.nameless()
