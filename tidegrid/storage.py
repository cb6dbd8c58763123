"""Samples, series and rollups as Parquet tables of one folder.

``samples`` is partitioned by day (``block``, its first millisecond) and by
``batch``: each write replaces its own batch folder, so a repeated write of a batch
(a retried stream) changes nothing.  ``compact`` rewrites a day's batches as one,
sorted by series and time, and drops repeated times.  ``rollup_5m`` has five-minute
buckets of compacted days; those of other days are made when they are read.  Retention removes whole days, of each table on its own,
so rollups may outlive raw samples.  ``recover`` removes what a crash left half made.

All listing and removal goes through Spark's file system layer: the folder may be
in any store that Spark can write.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadData, LimitExceeded, Unavailable
from .model import SERIES, identified, series_of
from .operators import admission, rollup
from .plans import engine
from .plans.engine import Store

DAY = 86_400_000
COMPACTED = -1
SAMPLES = "sid long, t long, v double, seq long, block long, batch long"
ROLLUPS = "sid long, e long, mn double, mx double, sm double, cnt long, la double, block long"


@dataclass(frozen=True)
class Written:
    """How many samples of a write were stored, and how many refused, by reason."""

    ok: int = 0
    late: int = 0
    duplicate: int = 0
    too_old: int = 0
    cardinality: int = 0

    @property
    def status(self) -> int:
        """The code a front end answers: 422 beyond the series limit, else 400 for too old samples, else 204."""
        return LimitExceeded.status if self.cardinality else BadData.status if self.too_old else 204

    def check(self) -> Written:
        """Itself, or the typed error of its status; accepted samples are stored all the same."""
        if self.cardinality:
            raise LimitExceeded(f"{self.cardinality} samples are of series beyond the limit")
        if self.too_old:
            raise BadData(f"{self.too_old} samples are too old")
        return self


@dataclass
class Storage:
    spark: SparkSession
    path: str
    block: int = DAY

    def _at(self, *parts: str) -> str:
        return "/".join([self.path.rstrip("/"), *parts])

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _exists(self, *parts: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._at(*parts)))

    def _remove(self, *parts: str) -> None:
        fs, path = self._fs()
        fs.delete(path(self._at(*parts)), True)

    def _folders(self, *parts: str) -> list[int]:
        """The numbers of partition folders; as many as days (or batches of one day)."""
        if not self._exists(*parts):
            return []
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self._at(*parts)))]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def _read(self, table: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", self._at(table))
        return reader.parquet(self._at(table)) if self._exists(table) else self.spark.createDataFrame([], schema)

    def blocks(self, table: str = "samples") -> list[int]:
        return self._folders(table)

    def series(self) -> DataFrame:
        return series_of(self._read("series", SERIES + ", batch long").select("sid", "labels", "label_key")) if self._exists("series") else self.spark.createDataFrame([], SERIES)

    def samples(self) -> DataFrame:
        """(sid, t, v, ...): the first written of each (series, time)."""
        rows = self._read("samples", SAMPLES)
        return rows.groupBy("sid", "t", "block").agg(F.min_by("v", F.struct("batch", "seq")).alias("v"))

    def _near(self, lo: int, hi: int) -> DataFrame:
        return self._read("samples", SAMPLES).filter(F.col("block").between(lo - self.block, hi) & F.col("t").between(lo, hi))

    def scan(self, lo: int, hi: int) -> DataFrame:
        """Samples with lo <= t <= hi: days are pruned, and the range reaches the Parquet scan."""
        return self._near(lo, hi).groupBy("sid", "t").agg(F.min_by("v", F.struct("batch", "seq")).alias("v"))

    def size(self) -> tuple[int, int]:
        """Number of stored samples (repeated ones counted again), or of rollups if those are more, and about that of series."""
        samples, series = self._read("samples", SAMPLES).agg(F.count("*"), F.approx_count_distinct("sid")).first()
        rolled, of = self._read("rollup_5m", ROLLUPS).agg(F.count("*"), F.approx_count_distinct("sid")).first()
        return max(samples, rolled), max(series, of)

    def store(self) -> Store:
        return Store(self.series(), self.scan, self.rollups(), self.size)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Store (labels, t, v, seq) rows; writing the same batch again replaces it."""
        known = identified(rows)
        block = F.col("t") - F.pmod(F.col("t"), F.lit(self.block))
        out = known.select("sid", "t", "v", "seq", block.alias("block"), F.lit(batch).cast("long").alias("batch"))
        tasks = self._tasks(rows.count())
        tasks = tasks if tasks > self.spark.sparkContext.defaultParallelism else 0
        # a day's rows of a batch meet in few files
        dealt = out.repartitionByRange(tasks, "block", "sid", "t") if tasks else out.repartition("block", F.pmod("sid", F.lit(16)))
        self._overwrite(dealt, "samples", ["block", "batch"])
        # each task's own series first, by hash: labels of all samples are neither sorted nor sent (a mere distinct is optimized away)
        own = series_of(known.groupBy("sid", "label_key").agg(F.count("*").alias("n")).filter("n > 0"))
        new = own.join(self.series().select("sid"), "sid", "left_anti") if self._exists("series") else own
        self._overwrite(new.withColumn("batch", F.lit(batch).cast("long")), "series", ["batch"])

    def write(self, rows: DataFrame, batch: int, window: int = 600_000, min_valid: int | None = None, most_series: int | None = None) -> Written:
        """Judge (labels, t, v, seq) rows against what is stored, store those admitted, and count both.

        One batch at a time: two writers would not see each other's newest times.
        """
        known = identified(rows)
        refused = known.limit(0)
        stored = self._read("samples", SAMPLES).filter(F.col("batch") != batch).select("sid", "t")
        if most_series is not None:
            known, refused = admission.limit_series(known, self.series().select("sid"), most_series)
        judged = admission.classify(known, window, min_valid, stored=stored).select("labels", "t", "v", "seq", "verdict").persist()
        try:
            counts = {r["verdict"]: r["n"] for r in admission.counters(judged).collect()}
            out = Written(**counts, cardinality=refused.count() if most_series is not None else 0)
            self.append(judged.filter(F.col("verdict").isin(*admission.ADMITTED)).drop("verdict"), batch)
            return out
        except Py4JJavaError as e:
            raise Unavailable(f"the batch was not stored: {e.java_exception.getMessage()}") from e
        finally:
            judged.unpersist()

    def recover(self) -> None:
        """Remove what a crash left: half-made compactions and uncommitted files. Stored batches stay."""
        self._remove("making")
        for table in ("samples", "series", "rollup_5m"):
            if self._exists(table):
                fs, path = self._fs()
                for s in fs.listStatus(path(self._at(table))):
                    if s.getPath().getName().startswith((".spark-staging", "_temporary")):
                        fs.delete(s.getPath(), True)

    def _tasks(self, samples: int) -> int:
        return -(-samples // engine.TASK_SAMPLES)

    def _overwrite(self, rows: DataFrame, table: str, by: list[str]) -> None:
        rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(self._at(table))

    def compact(self, *blocks: int, files: int = 8) -> None:
        """One sorted batch of each day in place of all, and the days' rollups; without blocks, every day of several batches.

        Each step has ``files`` tasks at least, and one for each TASK_SAMPLES, cut in order of days and series.  The
        new batch is written before the old ones go; a reader in between sees equal rows twice, which reading drops.
        """
        old = {day: [b for b in self._folders("samples", f"block={day}") if b != COMPACTED] for day in blocks or self.blocks()}
        days = sorted(day for day, batches in old.items() if batches)
        if not days:
            return
        rows = self._read("samples", SAMPLES).filter(F.col("block").isin(days))
        files = max(files, self._tasks(rows.count()))
        # grouped where they were cut
        first = rows.repartitionByRange(files, "block", "sid", "t").groupBy("block", "sid", "t").agg(F.min_by(F.struct("v", "seq"), F.struct("batch", "seq")).alias("x"))
        whole = first.select("sid", "t", "x.v", "x.seq", "block", F.lit(COMPACTED).cast("long").alias("batch"))
        # the old compacted batch is among what is read: the new one is made elsewhere first
        made = self._at("making", str(days[0]))
        whole.sortWithinPartitions("block", "sid", "t").write.mode("overwrite").option("compression", "zstd").parquet(made)
        ready = self.spark.read.schema(SAMPLES).parquet(made)
        self._overwrite(ready.repartitionByRange(files, "block", "sid", "t").sortWithinPartitions("block", "batch", "sid", "t"), "samples", ["block", "batch"])
        for day in days:
            for batch in old[day]:
                self._remove("samples", f"block={day}", f"batch={batch}")
        self._overwrite(self._rolled(days, files), "rollup_5m", ["block"])
        self._remove("making")

    def _ends(self, days: list[int]) -> list[int]:
        """Days that hold the ends of the buckets of these days' samples: the last bucket ends where the next day starts."""
        return sorted({d for day in days for d in (day, day + self.block)})

    def _rolled(self, days: list[int], tasks: int | None = None) -> DataFrame:
        """Buckets that end in the days of ``_ends``, from raw samples; in so many tasks, or as Spark decides."""
        ends = self._ends(days)
        near = self._near(ends[0] - rollup.RESOLUTION + 1, ends[-1] + self.block - 1)
        e = rollup.bucket_end(F.col("t"))
        rows = near.select("sid", "t", "v", "batch", "seq", e.alias("e"), (e - F.pmod(e, F.lit(self.block))).alias("block")).filter(F.col("block").isin(ends))
        # both groupings stay where the rows were cut
        rows = rows if tasks is None else rows.repartitionByRange(tasks, "block", "sid", "e")
        first = rows.groupBy("block", "sid", "e", "t").agg(F.min_by("v", F.struct("batch", "seq")).alias("v"))
        return rollup.reduced(first, "block", "sid", "e").select("sid", "e", "mn", "mx", "sm", "cnt", "la", "block")

    def rollups(self) -> DataFrame | None:
        """Stored buckets, and those of days that are not compacted from their raw samples; None before any compaction."""
        if not self._exists("rollup_5m"):
            return None
        stored = self._read("rollup_5m", ROLLUPS)
        open_ = [day for day in self.blocks() if self._folders("samples", f"block={day}") != [COMPACTED]]
        return stored.filter(~F.col("block").isin(self._ends(open_))).unionByName(self._rolled(open_)) if open_ else stored

    def retain(self, now: int, raw: int, rolled: int | None = None) -> None:
        """Remove days that ended before now - raw (samples) and now - rolled (rollups; default as raw)."""
        for table, keep in (("samples", raw), ("rollup_5m", raw if rolled is None else rolled)):
            for block in self.blocks(table):
                if block + self.block <= now - keep:
                    self._remove(table, f"block={block}")

    def stats(self) -> DataFrame:
        """(block, series, samples, first, last, files, bytes) of each day."""
        rows = self._read("samples", SAMPLES)
        out = rows.groupBy("block").agg(F.approx_count_distinct("sid").alias("series"), F.count("*").alias("samples"), F.min("t").alias("first"), F.max("t").alias("last"))
        if not self._exists("samples"):
            return out.select("*", F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"))
        files = rows.select("block", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).distinct()
        return out.join(files.groupBy("block").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")), "block")
