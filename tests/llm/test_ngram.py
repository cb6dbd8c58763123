from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import ngram, queries

from .conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return [*WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)})), "<end>"]


def brute(rows, held):
    words, pairs, triples, starts = Counter(), Counter(), Counter(), 0
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            t = split(text)
            starts += 1
            words.update(t)
            pairs.update(zip(["<start>", *t], t, strict=False))
            triples.update(zip(["<start>", *t], t, t[1:], strict=False))
    n, v = sum(words.values()), len(words)
    once = {"<start>": starts} | {w: c for w, c in words.items() if w != "<end>"}
    root = lambda x: (words[x] + 0.1) / (n + 0.1 * (v + 1))
    two = lambda u, x: (pairs[u, x] + ngram.K1 * root(x)) / (once.get(u, 0) + ngram.K1)
    three = lambda u, w, x: (triples[u, w, x] + ngram.K2 * two(w, x)) / (pairs[u, w] + ngram.K2)
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        t = split(text)
        base = sum(math.log10(root(x)) for x in t)
        score = math.log10(two("<start>", t[0])) + sum(math.log10(three(u, w, x)) for u, w, x in zip(["<start>", *t], t, t[1:], strict=False))
        out.append((i, h, len(t), sum(words[x] > 0 for x in t), n, base, score))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9) and g.score == pytest.approx(w[6], rel=1e-9)


def run(df, held):
    return sorted(ngram.score(df, held).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_query_against_brute_force(spark, documents):
    rows = [(d["doc_id"], d["text"]) for d in documents]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    same(sorted(queries.op9_ngram(spark, SMALL).collect(), key=lambda r: r.doc_id), brute(rows, held))


def test_odd_rows(frame):
    rows = [(1, "A b a"), (2, None), (3, ""), (4, "never seen é"), (4, "a b a"), (None, "b b"), (6, "w " * 3000)]
    same(run(frame(rows), F.coalesce(F.col("doc_id"), F.lit(0)).isin(3, 6)), brute(rows, [i in (3, 6) for i, _ in rows]))


def test_no_training_rows_and_an_empty_table(frame):
    rows = [(1, "a b"), (2, None)]
    same(run(frame(rows), F.lit(True)), brute(rows, [True, True]))
    assert ngram.score(frame([]), F.lit(False)).count() == 0


def automaton_of(texts, held):
    b = ngram.Block(pa.table({"text": pa.array(texts, pa.string()), "held_out": held}))
    w = b.words()
    trained = held.count(False)
    return b, ngram.Automaton(b, w, b.pairs(), b.triples(np.flatnonzero(b.inner())), int(w.counts.sum()) + trained, int((w.counts > 0).sum()) + 1, trained)


def test_probabilities_of_every_state_sum_to_one():
    # every token after every two words, in texts that are not learnt from, so that each arc is at some place
    tokens = ["a", "b", "c", "unseen"]
    probes = [f"{x} {y} {z}" for x in tokens for y in tokens for z in tokens] + [f"{x} {y}" for x in tokens for y in tokens]
    texts = ["a b a c", "b a", "a a b", "", "c c c a b"]
    b, m = automaton_of(texts + probes, [False] * 5 + [True] * len(probes))
    after: dict[int, dict[int, float]] = {}
    for i in range(5, len(texts) + len(probes)):
        state = np.array([m.start])
        for at in range(b.off[i], b.off[i + 1]):
            nxt, w = m.step(state, m.number[at : at + 1], m.arc1[at : at + 1], m.arc2[at : at + 1])
            after.setdefault(int(state[0]), {})[int(m.number[at])] = 10 ** float(w[0])
            state = nxt
    full = [p for p in after.values() if len(p) == 5]
    assert len(full) >= 10
    assert [sum(p.values()) for p in full] == pytest.approx([1] * len(full))


def test_pieces_do_not_change_scores(monkeypatch, prose):
    _, m = automaton_of([prose(k, n, 30) for k, n in enumerate((1, 3, 700, 2000, 0))], [False, True, False, True, False])
    whole = None
    for piece in (5000, 256, 3):
        monkeypatch.setattr(ngram, "PIECE", piece)
        whole = m.traverse() if whole is None else whole
        assert m.traverse() == pytest.approx(whole)


def test_clashing_columns_and_a_long_text(spark, prose):
    long = prose(4, 60000, 3000)
    rows = [(1, long, 7, True), (2, long[:500], 8, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block long, held_out boolean")
    want = brute([(1, long), (2, long[:500])], [False, True])
    same(run(df, F.col("doc_id") == 2), want)
