"""Toxicity by a bidirectional gated recurrent network with attention (operator 7).

Every token enters as a word vector (hashed) beside the mean vector of its hashed
character 3- to 5-grams.  A gated recurrent layer reads each window of ``WINDOW``
tokens in both directions, attention pools its states, a logistic unit scores it.
Windows overlap by half and cover the whole text; a text's score is its highest
window's.  Trained in numpy by back-propagation (Adam): labels belong to texts, so
after two passes over all windows each toxic text teaches through its windows of
highest score, and each clean one through its highest and some others.

Fitting takes a bounded sample of the labelled texts: of each class at most ``SAMPLE``
distinct ones, those of the least hashes, and no more of them than ``SAMPLE_BYTES``
hold (a text that does not fit is passed over).  Scoring takes one pass without a
shuffle and reads whole texts.

Cases: null, empty or token-free texts score 0; without both classes among the
labels every text scores 0; a text labelled both ways counts as toxic; labels
without a text and texts without a label take no place in the sample; equal texts of
a class are learnt once; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import _FOLD
from .langid import share
from .textarrays import Chunk, chunks, mix, word_hashes, words

#: Texts learnt from, of each class.
SAMPLE = 1200
SAMPLE_BYTES = 16 << 20
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, D, H, A = 1 << 12, 1 << 13, 8, 8, 8
#: Windows scored at once.
BATCH = 2048


def gram_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character 3- to 5-grams of words (with borders), flat, and how many each word has."""
    n = end - start + 2
    off = np.concatenate([[0], np.cumsum(n)])
    flat = np.full(int(off[-1]) + 4, 0, np.uint64)
    inner = np.ones(int(off[-1]), bool)
    inner[off[:-1]] = False
    inner[off[1:] - 1] = False
    of = np.repeat(start - off[:-1] - 1, n)
    spot = np.arange(int(off[-1]))
    flat[: len(spot)][inner] = data[(spot + of)[inner]]
    flat[off[:-1]] = 1
    flat[off[1:] - 1] = 2
    left = np.repeat(off[1:], n) - spot  # bytes from here to the word's end
    word = np.repeat(np.arange(len(n)), n)
    h = flat[: len(spot)].copy()
    rows, whose = [], []
    for k in range(1, 5):
        h = h * np.uint64(1000003) + flat[k : k + len(spot)]
        if k >= 2:
            ok = left > k
            rows.append((mix(h[ok]) & np.uint64(GRAM_ROWS - 1)).astype(np.int32))
            whose.append(word[ok])
    rows, whose = np.concatenate(rows), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return rows[order], np.bincount(whose, minlength=len(n))


class Net:
    """Parameters, the forward pass, and its gradient."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        init = lambda *s, k=None: (r.standard_normal(s) * (k or 1 / np.sqrt(s[-2]))).astype(np.float32)
        self.p = {
            "word": init(WORD_ROWS, D, k=0.3), "gram": init(GRAM_ROWS, D, k=0.6), "x": init(2, 2 * D, 3 * H), "bx": np.zeros((2, 1, 3 * H), np.float32),
            "u": init(2, H, 3 * H), "a": init(2 * H, A), "ba": np.zeros(A, np.float32), "v": init(A, 1)[:, 0], "w": init(2 * H, 1)[:, 0], "b": np.full(1, -2, np.float32),
        }

    def inputs(self, word: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Vectors of distinct words; every word has a gram, its border."""
        g = np.add.reduceat(self.p["gram"][grams], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        return np.hstack([self.p["word"][word], g / counts[:, None].astype(np.float32)])

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["x"] + self.p["bx"]

    def forward(self, px: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows: px projected words, at (windows, WINDOW) word numbers, mask of real tokens."""
        p, (n, t) = self.p, at.shape
        h = np.zeros((2, n, H), np.float32)
        hs = np.empty((t, n, 2 * H), np.float32)
        held = []
        for i in range(t):
            j = t - 1 - i
            x = np.stack([px[0][at[:, i]], px[1][at[:, j]]])
            m = np.stack([mask[:, i], mask[:, j]])[:, :, None]
            hu = h @ p["u"]
            zr = 1 / (1 + np.exp(-(x[..., : 2 * H] + hu[..., : 2 * H])))
            z, r = zr[..., :H], zr[..., H:]
            c = np.tanh(x[..., 2 * H :] + r * hu[..., 2 * H :])
            new = np.where(m, h + z * (c - h), h)
            if keep:
                held.append((h, hu, z, r, c, m))
            h = new
            hs[i, :, :H] = h[0]
            hs[j, :, H:] = h[1]
        u = np.tanh(hs @ p["a"] + p["ba"])
        e = np.where(mask.T, u @ p["v"], -30)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, hs)
        return pooled @ p["w"] + p["b"][0], {"hs": hs, "u": u, "a": a, "pooled": pooled, "held": held} if keep else {}

    def gradient(self, d: np.ndarray, px: np.ndarray, at: np.ndarray, c: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the projection, and of px, from those of the logits."""
        p, (n, t) = self.p, at.shape
        g = {"w": c["pooled"].T @ d, "b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["w"]
        da = np.einsum("nk,tnk->tn", dp, c["hs"])
        de = c["a"] * (da - (c["a"] * da).sum(axis=0))
        dhs = c["a"][..., None] * dp
        g["v"] = np.einsum("tn,tna->a", de, c["u"])
        du = de[..., None] * p["v"] * (1 - c["u"] ** 2)
        g["a"] = np.einsum("tnk,tna->ka", c["hs"], du)
        g["ba"] = du.sum(axis=(0, 1))
        dhs += du @ p["a"].T
        g["u"] = np.zeros_like(p["u"])
        dpx = np.zeros_like(px)
        dh = np.zeros((2, n, H), np.float32)
        for i in range(t - 1, -1, -1):
            j = t - 1 - i
            h, hu, z, r, k, m = c["held"][i]
            dh += np.stack([dhs[i, :, :H], dhs[j, :, H:]])
            live = dh * m
            dk = live * z * (1 - k * k)
            dz = live * (k - h) * z * (1 - z)
            dr = dk * hu[..., 2 * H :] * r * (1 - r)
            dx = np.concatenate([dz, dr, dk], axis=2)
            dhu = np.concatenate([dz, dr, dk * r], axis=2)
            g["u"] += np.swapaxes(h, 1, 2) @ dhu
            np.add.at(dpx[0], at[:, i], dx[0])
            np.add.at(dpx[1], at[:, j], dx[1])
            dh = np.where(m, dh * (1 - z), dh) + dhu @ np.swapaxes(p["u"], 1, 2)
        return g, dpx


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first token, end of its document) of all overlapping windows; off: token offsets."""
    n = np.diff(off)
    k = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), k)
    first = off[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k))
    return doc, first, off[doc + 1]


def vocabulary(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token offsets, word number of each token, word rows, gram rows, gram counts) of a folded chunk."""
    w = words(c)
    distinct, first, of = np.unique(word_hashes(c, w), return_index=True, return_inverse=True)
    grams, counts = gram_rows(c.data, w.start[first], w.end[first]) if len(first) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return w.docs, of, (distinct & np.uint64(WORD_ROWS - 1)).astype(np.int32), grams, counts


def spots(first: np.ndarray, end: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = first[:, None] + np.arange(WINDOW)
    mask = at < end[:, None]
    return of[np.where(mask, at, 0)], mask


def score_column(net: Net, column: pa.Array) -> np.ndarray:
    out = []
    for c in chunks(column):
        off, of, word, grams, counts = vocabulary(Chunk(c.first, _FOLD[c.data], c.offsets))
        best = np.full(c.n_docs, -np.inf)
        if len(of):
            px = net.project(net.inputs(word, grams, counts))
            doc, first, end = windows(off)
            for i in range(0, len(doc), BATCH):
                s = slice(i, i + BATCH)
                logits, _ = net.forward(px, *spots(first[s], end[s], of))
                np.maximum.at(best, doc[s], logits)
        out.append(1 / (1 + np.exp(-best)))
    return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 9, size: int = 256, seed: int = 9) -> Net:
    """A network for texts with 0/1 labels; the same for the same rows."""
    net, rng = Net(), np.random.default_rng(seed)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    off, of, word, grams, counts = vocabulary(Chunk(0, _FOLD[data], offsets))
    gram_off = np.concatenate([[0], np.cumsum(counts)])
    doc, first, end = windows(off)
    y = labels[doc].astype(np.float32)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    toxic, clean = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    for epoch in range(epochs):
        if epoch < 2:
            pos, neg = toxic, clean
        else:
            px = net.project(net.inputs(word, grams, counts))
            logits = np.concatenate([net.forward(px, *spots(first[i : i + BATCH], end[i : i + BATCH], of))[0] for i in range(0, len(doc), BATCH)])
            order = np.lexsort((-logits, doc))
            place = np.empty(len(doc), np.int64)
            starts = np.searchsorted(doc, np.arange(len(texts)))
            place[order] = np.arange(len(doc)) - starts[doc[order]]
            pos = np.flatnonzero((y > 0) & ((place == 0) | ((logits > 1) & (place < 4))))
            neg = np.concatenate([np.flatnonzero((y == 0) & (place < 2)), rng.permutation(clean)[: len(pos)]])
        pick = rng.permutation(np.concatenate([pos, neg]))
        balance = len(neg) / max(1, len(pos))
        for i in range(0, len(pick), size):
            rows = pick[i : i + size]
            at, mask = spots(first[rows], end[rows], of)
            used, local = np.unique(at, return_inverse=True)
            n = counts[used]
            flat = grams[np.repeat(gram_off[used], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            x = net.inputs(word[used], flat, n)
            px = net.project(x)
            local = local.reshape(at.shape)
            logits, cache = net.forward(px, local, mask, keep=True)
            q = 1 / (1 + np.exp(-logits))
            d = ((q - y[rows]) * np.where(y[rows] > 0, balance, 1) / len(rows)).astype(np.float32)
            g, dpx = net.gradient(d, px, local, cache)
            g["bx"] = dpx.sum(axis=1, keepdims=True)
            g["x"] = np.swapaxes(np.broadcast_to(x, (2, *x.shape)), 1, 2) @ dpx
            dx = (dpx @ np.swapaxes(net.p["x"], 1, 2)).sum(axis=0)
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], word[used], dx[:, :D])
            g["gram"] = np.zeros_like(net.p["gram"])
            np.add.at(g["gram"], flat, np.repeat(dx[:, D:] / n[:, None].astype(np.float32), n, axis=0))
            step += 1
            rate = 0.02 * (1 - 0.85 * (epoch + i / len(pick)) / epochs)
            for k, v in net.p.items():
                a, b = moment[k]
                a += 0.1 * (g[k] - a)
                b += 0.01 * (g[k] ** 2 - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net | None:
    """A network from labelled texts; the driver holds the bounded sample alone. None without two classes."""
    of = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    # first which texts, from hashes and sizes: no text is moved for that
    known = texts.select("_id", "h", F.octet_length("t").alias("n")).join(of, "_id").select("y", "h", "n")
    many = {r["y"]: r["d"] for r in known.groupBy("y").agg(F.approx_count_distinct("h").alias("d")).collect()}
    if len(many) < 2:
        return None
    # about four times the sample are under this bound, however many texts there are
    bound = F.when(F.col("y") == 1, 4.0 * per_class / many[1]).otherwise(4.0 * per_class / many[0])
    near = known.filter(share(F.col("h")) < bound).groupBy("y", "h").agg(F.max("n").alias("n")).collect()
    chosen: list[tuple[int, int]] = []
    for y in (0, 1):
        held = taken = 0
        for r in sorted((r for r in near if r["y"] == y), key=lambda r: r["h"] % (1 << 64)):
            if taken < per_class and held + r["n"] <= SAMPLE_BYTES:
                held, taken = held + r["n"], taken + 1
                chosen.append((y, r["h"]))
    if len({y for y, _ in chosen}) < 2:
        return None
    keys = docs.sparkSession.createDataFrame(chosen, "y int, h long")  # two classes of per_class at most
    one = texts.join(F.broadcast(keys), "h").groupBy("y", "h").agg(F.first("t").cast("binary").alias("t"))
    rows = sorted((r["h"], r["y"], bytes(r["t"])) for r in one.collect())
    return train([r[2] for r in rows], np.array([r[1] for r in rows]))


def score(df: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """df without its text, with a score between 0 and 1 (a column of that name is replaced). No shuffle."""
    kept = df.drop("score")
    held = df.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != text_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            s = score_column(held.value, b.column(at)) if held.value is not None and b.num_rows else np.zeros(b.num_rows)
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.record_batch([*cols, pa.array(s.astype(float))], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)
