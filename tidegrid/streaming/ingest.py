"""Streams of lines into storage, with admission by series.

State of a series is its newest time and the late times inside the window.  The
window belongs to the series, so a watermark over the whole stream cannot express
it: a processor with state decides.  Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import identified
from ..operators.admission import ADMITTED, DUPLICATE, LATE, OK, TOO_OLD
from ..storage import Storage

JUDGED = "sid long, labels map<string,string>, t long, v double, seq long, verdict string"


class Admission(StatefulProcessor):
    """Judges a series' samples in arrival order within a batch, batches in their order."""

    def __init__(self, window: int, min_valid: int | None = None):
        self.window, self.min_valid = window, min_valid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "t long")
        self.seen = handle.getMapState("seen", "t long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seq", kind="stable")
        newest = self.newest.get()[0] if self.newest.exists() else None
        verdicts = []
        for t in got["t"].tolist():
            verdict = self.judge(t, newest)
            if verdict in ADMITTED:
                self.seen.updateValue((t,), (1,))
                newest = t if newest is None else max(newest, t)
            verdicts.append(verdict)
        if newest is not None:
            self.newest.update((newest,))
            for (t,) in list(self.seen.keys()):
                if t < newest - self.window:
                    self.seen.removeKey((t,))
        got["verdict"] = verdicts
        yield got[["sid", "labels", "t", "v", "seq", "verdict"]]

    def judge(self, t: int, newest: int | None) -> str:
        if self.min_valid is not None and t < self.min_valid:
            return TOO_OLD
        if newest is None or t > newest:
            return OK
        if t == newest:
            return DUPLICATE
        if t < newest - self.window:
            return TOO_OLD
        return DUPLICATE if self.seen.containsKey((t,)) else LATE

    def close(self) -> None:
        pass


def admit(samples: DataFrame, window: int = 600_000, min_valid: int | None = None) -> DataFrame:
    """A stream of samples (labels, t, v, seq) with their verdicts."""
    rows = identified(samples).select("sid", "labels", "t", "v", "seq")
    return rows.groupBy("sid").transformWithStateInPandas(statefulProcessor=Admission(window, min_valid), outputStructType=JUDGED, outputMode="Append", timeMode="None")


def store_stream(judged: DataFrame, storage: Storage, checkpoint: str, on_batch: Callable[[int, DataFrame], None] | None = None, **trigger):
    """Write the admitted samples of a judged stream; a batch repeated after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            storage.append(batch.filter(F.col("verdict").isin(*ADMITTED)).select("labels", "t", "v", "seq"), batch_id)
            if on_batch:
                on_batch(batch_id, batch)
        finally:
            batch.unpersist()

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def line_stream(spark, path: str, precision: str = "ns", now: int | None = None, files: int = 100) -> DataFrame:
    """Lines of the text files that arrive in a folder, as (seq, labels, t, v, skipped, error)."""
    from ..sources import lineprotocol

    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return lineprotocol.parse(lines, precision, now)
