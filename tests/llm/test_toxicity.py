from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import queries, toxicity
from tidegrid.llm.decontaminate import _FOLD
from tidegrid.llm.langid import fold
from tidegrid.llm.textarrays import Chunk

from .conftest import SMALL


def test_gradient_is_the_slope_of_the_loss():
    net = toxicity.Net(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = np.frombuffer(b"some bad words here and then some more words again", np.uint8)
    off, of, word, grams, counts = toxicity.vocabulary(Chunk(0, _FOLD[raw], np.array([0, len(raw)])))
    doc, first, end = toxicity.windows(off)
    at, mask = toxicity.spots(first, end, of)
    px = net.project(net.inputs(word, grams, counts))

    def loss():
        return float(net.forward(px, at, mask)[0].sum())

    _, cache = net.forward(px, at, mask, keep=True)
    g, dpx = net.gradient(np.ones(len(doc)), px, at, cache)
    for name, cell in (("w", (3,)), ("a", (2, 1)), ("v", (4,)), ("u", (0, 1, 3)), ("u", (1, 2, 20)), ("ba", (1,))):
        before = net.p[name][cell]
        net.p[name][cell] = before + 1e-3
        up = loss()
        net.p[name][cell] = before - 1e-3
        down = loss()
        net.p[name][cell] = before
        assert g[name][cell] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-4)
    before = px[0, 2, 5]
    px[0, 2, 5] = before + 1e-3
    up = loss()
    px[0, 2, 5] = before - 1e-3
    down = loss()
    assert dpx[0, 2, 5] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-4)


def test_windows_overlap_and_cover():
    doc, first, end = toxicity.windows(np.array([0, 0, 5, 105, 137]))
    assert doc.tolist() == [1, *[2] * 6, 3]
    seen = set()
    for f, e in zip(first, end, strict=True):
        seen |= set(range(f, min(e, f + toxicity.WINDOW)))
    assert seen == set(range(137))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxicity(spark, sf).collect()]
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.05


def test_odd_rows(spark, frame):
    rows = [(1, None), (2, ""), (3, "you are a vile fool"), (3, "you are a vile fool"), (None, "kind words"), (5, "kind words"), (6, "!!! ...")]
    df = frame(rows)
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (1, 1), (9, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    out = {r.doc_id: r.score for r in toxicity.score(df.selectExpr("*", "9 as score"), net).collect()}
    assert out[1] == out[2] == out[6] == 0 and 0 < out[5] < 1 and out[3] > out[5]
    assert toxicity.fit(df, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(frame([]), net).count() == 0


def test_every_window_of_a_long_text_counts():
    net = toxicity.train([b"vile fool hate you " * 2, b"the green tree stands there"] * 800, np.array([1, 0] * 800))
    calm = "the green tree stands there " * 3000
    s = toxicity.score_column(net, pa.array([calm, calm + "vile fool hate you " * 3, "vile fool hate you " * 3 + calm]))
    assert s[0] < 0.5 < min(s[1], s[2])


def test_the_first_epochs_take_every_window(monkeypatch):
    texts = [b"vile fool hate you " * 40] * 700 + [b"the green tree stands there " * 40] * 2100
    _, first, _ = toxicity.windows(np.cumsum([0, *[len(t.split()) for t in texts]]))
    seen, forward = [], toxicity.Net.forward

    def counted(net, px, at, mask, keep=False):
        seen.append(len(at) if keep else 0)
        return forward(net, px, at, mask, keep)

    monkeypatch.setattr(toxicity.Net, "forward", counted)
    toxicity.train(texts, np.array([1] * 700 + [0] * 2100), epochs=1)
    assert sum(seen) == len(first) > 18_000


def test_labels_without_texts_take_no_place_in_the_sample(spark, frame, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.append((len(texts), int(sum(labels)), sum(map(len, texts)))))
    docs = frame([(i, f"text {i} " + "w " * (i % 3) * 1000) for i in range(80)] + [(i, "twice the same") for i in (3, 5, 5)] + [(None, "no id")])
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20_000)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert taken[0][:2] == (81, 41)  # each text once, and the one that two toxic documents share
    toxicity.fit(docs, labels, per_class=30)
    assert taken[1][:2] == (60, 30)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10_000)
    toxicity.fit(docs, labels)
    assert taken[2][2] <= 20_000 and taken[2][0] > 30
    assert toxicity.fit(docs, labels.filter("doc_id > 100")) is None


def test_query_scores_are_those_of_single_texts(spark, documents):
    """The query against the network run over one text after the other, each window by itself."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = toxicity.fit(docs.filter(fold("doc_id", 3) != 1), spark.read.parquet(f"{SMALL}/labels.parquet").filter(fold("doc_id", 3) != 1))
    rows = {r.doc_id: r.score for r in queries.op7_toxicity(spark, SMALL).collect()}
    for d in documents[:40]:
        want = 0.0
        tokens = [t for t in bytes(_FOLD[np.frombuffer((d["text"] or "").encode(), np.uint8)]).split()]
        if tokens:
            starts = [0, *range(toxicity.STRIDE, len(tokens) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)]
            want = max(float(toxicity.score_column(net, pa.array([b" ".join(tokens[s : s + toxicity.WINDOW]).decode()]))[0]) for s in starts)
        assert rows[d["doc_id"]] == pytest.approx(want, abs=1e-4)
