"""Benchmark decontamination by greedy string tiling (operator 8).

Tokens are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
bytes.  A seed is five neighbouring tokens.

1. Texts are judged, not rows: a text goes by 128 bits of hash, so copies are judged
   once.  A bit table of fixed size says which seeds may be in the benchmark, and one
   pass over the documents keeps each text's seeds that pass.
2. Seeds meet in a join.  An item that is covered to ``COVERAGE`` shares seeds that
   cover as many tokens, so an item is posted only under its rarest seeds: the
   commonest ones are left out as long as they could not cover enough by themselves.
   For each pair found, the tokens that all shared seeds cover are summed, and pairs
   that cannot reach the threshold go.  Both bounds are exact; no text is moved yet.
3. The rest is tiled: the longest common run of tokens not yet covered is marked, and
   so on while runs of five remain.  Each round runs Karp-Rabin hashes of one search
   length over both texts; the length is found by bisection and only ever shrinks.

The share of an item's tokens under tiles is its coverage; since tiles may lie
anywhere, reordered passages count.  A document is contaminated if an item reaches
``COVERAGE``.  The path is the same for a benchmark of any size.

Cases: null or empty texts and items with fewer than five tokens never match; an
empty benchmark leaves all clean; items without an id are left out, those with equal
ids count each; of items with equal coverage the least id is reported; coverage is 0
and no item is named where none reaches the threshold; repeated rows are judged each;
a very long text is tiled whole, in memory linear in its length; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import written
from .textarrays import Chunk, chunks, mix, shingle_hashes, within, word_hashes, words

SEED = 5
COVERAGE = 0.6
#: Bits of the table of seeds, whatever the benchmark's size: 8 MB.
BITS = 26
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def token_chunks(column: pa.Array) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """(chunk, token hashes, token offsets of its documents)."""
    for c in chunks(column):
        c = Chunk(c.first, _FOLD[c.data], c.offsets)
        w = words(c)
        yield c, word_hashes(c, w), w.docs


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Rolling:
    """Karp-Rabin hashes of all windows of any length, from one running sum, and the tokens marked so far."""

    def __init__(self, tokens: np.ndarray):
        self.n = len(tokens)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(tokens * _powers(_BASE, self.n), out=self.sums[1:])
        self.back = _powers(_BACK, self.n + 1)
        self.marked = np.zeros(self.n, bool)
        self.count = np.zeros(self.n + 1, np.int64)

    def mark(self, at: int, length: int) -> None:
        self.marked[at : at + length] = True

    def settle(self) -> None:
        np.cumsum(self.marked, out=self.count[1:])

    def free(self, starts: np.ndarray, s: int) -> np.ndarray:
        """Those starts whose window of s tokens is inside and unmarked."""
        starts = starts[starts <= self.n - s]
        return starts[self.count[starts + s] == self.count[starts]]

    def hashes(self, starts: np.ndarray, s: int) -> np.ndarray:
        return mix((self.sums[starts + s] - self.sums[starts]) * self.back[starts])


def tile(item: np.ndarray, doc: np.ndarray, k: int = SEED) -> np.ndarray:
    """Which tokens of item lie under tiles of doc.

    Of longest matches the one first in doc is marked, at its first free place in item.
    """
    a, b = Rolling(item), Rolling(doc)
    spots, starts = np.arange(max(0, a.n - k + 1)), np.arange(max(0, b.n - k + 1))
    s = min(a.n, b.n)

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(free windows of doc that item has, their hashes, free windows of item by hash, these hashes)."""
        i, j = a.free(spots, length), b.free(starts, length)
        hi, hj = a.hashes(i, length), b.hashes(j, length)
        order = np.argsort(hi, kind="stable")
        i, hi = i[order], hi[order]
        hit = np.zeros(len(j), bool)
        if len(hi):
            hit = hi[np.minimum(np.searchsorted(hi, hj), len(hi) - 1)] == hj
        return j[hit], hj[hit], i, hi

    starts = matches(k)[0] if s >= k else starts[:0]  # a longer match starts at a seed
    while len(starts) and s >= k:
        low, high = k - 1, s  # the longest match is in low..high: if s tokens match, fewer do
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(matches(middle)[0]) else (low, middle - 1)
        s = low
        if s < k:
            break
        j, hj, i, hi = matches(s)
        done = 0
        for at, lo, hi_ in zip(j.tolist(), np.searchsorted(hi, hj, "left").tolist(), np.searchsorted(hi, hj, "right").tolist(), strict=True):
            if at < done:
                continue
            for place in i[lo:hi_].tolist():
                if not a.marked[place : place + s].any():
                    a.mark(place, s)
                    b.mark(at, s)
                    done = at + s
                    break
        a.settle()
        b.settle()
        starts = matches(k)[0]
    return a.marked


def needed(n: int) -> int:
    """The least number of tokens of n that is a share of ``COVERAGE``."""
    m = int(n * COVERAGE)
    while m / n < COVERAGE:
        m += 1
    return m


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(irow, item_id, item, need, seeds, gains) of items with a seed: distinct seeds and the tokens that each covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for c, h, off in token_chunks(batch.column(2)) if batch.num_rows else ():
                s = shingle_hashes(h, SEED)
                for r in range(c.n_docs):
                    lo, hi = int(off[r]), int(off[r + 1])
                    if hi - lo < SEED:
                        continue
                    own = s[lo : hi - SEED + 1]
                    order = np.argsort(own, kind="stable")
                    k = own[order]
                    same = k[1:] == k[:-1]
                    gain = np.full(len(k), SEED)
                    gain[1:][same] = np.minimum(SEED, np.diff(order)[same])  # occurrences may overlap
                    at = np.flatnonzero(np.concatenate([[True], ~same]))
                    i = c.first + r
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), needed(hi - lo), k[at].view(np.int64).tolist(), np.add.reduceat(gain, at).tolist()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["irow", "item_id", "item", "need", "seeds", "gains"])

    known = benchmark.select(F.monotonically_increasing_id().alias("irow"), F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("item")).filter("item_id is not null and item is not null")
    return written(known.mapInArrow(run, "irow long, item_id long, item string, need long, seeds array<long>, gains array<long>"), "items")


def _maybe(items: DataFrame) -> np.ndarray:
    """The bit table of the benchmark's seeds."""
    word = F.shiftrightunsigned("seed", 6).bitwiseAND((1 << (BITS - 6)) - 1)
    table = items.select(F.explode("seeds").alias("seed")).groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for r in table.collect():  # at most the words of the bit table, whatever the benchmark's size
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def _shared(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, seed): the distinct seeds of each text that the benchmark may have."""
    held = texts.sparkSession.sparkContext.broadcast(_maybe(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, h, off in token_chunks(batch.column(2)) if batch.num_rows else ():
                s = shingle_hashes(h, SEED)
                row = np.repeat(np.arange(c.n_docs), np.diff(off))[: len(s)]
                hit = (held.value[((s >> np.uint64(6)) & np.uint64((1 << (BITS - 6)) - 1)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1)
                at = np.flatnonzero((hit > 0) & within(off, SEED, len(s))) if len(s) else np.zeros(0, np.int64)
                which = pa.array(row[at] + c.first)
                yield pa.record_batch([batch.column(0).take(which), batch.column(1).take(which), pa.array(s[at].view(np.int64))], names=["k1", "k2", "seed"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, seed long").distinct()


def candidates(shared: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, irow): pairs whose shared seeds cover enough of the item. Seeds are joined under exact bounds, texts are not read."""
    owned = items.select("irow", "need", F.explode(F.arrays_zip("seeds", "gains")).alias("z")).select("irow", "need", F.col("z.seeds").alias("seed"), F.col("z.gains").alias("gain"))
    counted = owned.join(shared.groupBy("seed").agg(F.count("*").alias("df")), "seed")
    # from the commonest on, seeds that together cover less than needed may be left out
    commonest = Window.partitionBy("irow").orderBy(F.desc("df"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    posted = counted.withColumn("sum", F.sum("gain").over(commonest)).filter("sum >= need").select("seed", "irow")
    met = shared.join(posted, "seed").select("k1", "k2", "irow").distinct()
    covered = met.join(owned, "irow").join(shared, ["k1", "k2", "seed"]).groupBy("k1", "k2", "irow").agg(F.sum("gain").alias("sum"), F.first("need").alias("need"))
    return covered.filter("sum >= need").select("k1", "k2", "irow")


def judge(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_items, item_id, coverage, contaminated) of every row."""
    items = _items(benchmark, item_col, item_text)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), "text")
    found = written(candidates(_shared(docs, items), items), "pairs")
    texts = docs.select("k1", "k2", "text").join(found.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    pairs = found.join(items.select("irow", "item_id", "item"), "irow").join(texts, ["k1", "k2"]).select("k1", "k2", "item_id", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = []
            for item, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                (_, x, _), *_ = token_chunks(pa.array([item], pa.string()))
                (_, y, _), *_ = token_chunks(pa.array([text], pa.string()))
                share.append(float(tile(x, y).mean()))
            yield pa.record_batch([*b.columns[:3], pa.array(share, pa.float64())], names=["k1", "k2", "item_id", "coverage"])

    tiled = pairs.mapInArrow(run, "k1 long, k2 long, item_id long, coverage double").filter(F.col("coverage") >= COVERAGE)
    # written: a join of two scans can split a group of copies, one with an aggregate cannot
    best = written(tiled.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.struct("coverage", (-F.col("item_id")).alias("i"))).alias("x")), "covered")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [x for _, _, off in token_chunks(b.column(3)) for x in np.diff(off).tolist()] if b.num_rows else []
            yield pa.record_batch([*b.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "k1", "k2", "n_tokens"])

    out = docs.mapInArrow(count, "doc_id long, k1 long, k2 long, n_tokens long").join(best, ["k1", "k2"], "left")
    return out.select("doc_id", "n_tokens", F.coalesce("n", F.lit(0)).alias("n_items"), (-F.col("x.i")).alias("item_id"), F.coalesce("x.coverage", F.lit(0.0)).alias("coverage"), F.col("n").isNotNull().alias("contaminated"))
