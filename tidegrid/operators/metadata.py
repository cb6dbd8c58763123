"""Questions about series and labels: the small table alone, or with a look at the samples' times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadData
from ..plans import language as q
from ..plans.engine import Store
from .select import select_series

#: Milliseconds of the years 1 to 9999: every time a stored timestamp can have.
ALWAYS = (-62_135_596_800_000, 253_402_300_799_999)


def selected(store: Store, match: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """(sid, label_key) of the series that any selector takes, with a sample between start and end if those are given."""
    out = None
    for text in match:
        tree = q.parse(text)
        if not isinstance(tree, q.Selector) or tree.range is not None:
            raise BadData(f"not a series selector: {text}")
        found = select_series(store.series, tree.matchers)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise BadData("a selector is needed")
    out = out.dropDuplicates(["sid"]) if len(match) > 1 else out
    if start is not None or end is not None:
        lo, hi = ALWAYS[0] if start is None else start, ALWAYS[1] if end is None else end
        out = out.join(store.scan(lo, hi).select("sid"), "sid", "left_semi")
    return out


def series(store: Store, match: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """(label_key) of the distinct label sets."""
    return selected(store, match, start, end).select("label_key").distinct()


def _of(store: Store, match: list[str] | None, start: int | None, end: int | None) -> DataFrame:
    # without a selector the whole table answers, and the times play no part
    rows = selected(store, match, start, end) if match else store.series
    return rows.select(F.explode("label_key").alias("x")).select("x.key", "x.value")


def label_names(store: Store, match: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    return _of(store, match, start, end).select(F.col("key").alias("name")).distinct()


def label_values(store: Store, name: str, match: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    return _of(store, match, start, end).filter(F.col("key") == name).select("value").distinct()


def cardinality(store: Store, top: int = 10) -> DataFrame:
    """(name, n): the labels with the most values."""
    counted = _of(store, None, None, None).groupBy("key").agg(F.count_distinct("value").alias("n"))
    return counted.orderBy(F.desc("n"), "key").limit(top).select(F.col("key").alias("name"), "n")


def export(store: Store, match: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """(sid, label_key, timestamps, values): the raw samples of each series in time order, the first of equal times."""
    found = selected(store, match)
    lo, hi = ALWAYS[0] if start is None else start, ALWAYS[1] if end is None else end
    rows = store.scan(lo, hi).join(found.select("sid"), "sid", "left_semi")
    lists = rows.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return lists.join(found, "sid").select("sid", "label_key", F.col("s.t").alias("timestamps"), F.col("s.v").alias("values"))
