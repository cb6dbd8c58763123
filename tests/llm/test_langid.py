from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from tidegrid.llm import langid, queries

from .conftest import SMALL


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op10_language(spark, sf).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) > 200
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.97


def test_query_columns(spark, documents):
    rows = {r.doc_id: r for r in queries.op10_language(spark, SMALL).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        r = rows[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d["text"] or ""))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_families_and_the_pairs_within(spark):
    words = {"de": "der die und nicht ist ein", "nl": "de het een niet is van", "fr": "le la les et des une", "xx": "qoq zuz woq kuk zaq"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[lang].split(), 30)), lang) for i, lang in enumerate(list(words) * 30)]
    model = langid.fit(labelled(spark, rows))
    assert model.families == {"germanic": ["de", "nl"], "romance": ["fr"], "~xx": ["xx"]}
    assert ("de", "nl") in model.machines and ("de", "fr") not in model.machines
    got = langid.predict(labelled(spark, rows), model).filter("lang_pred = lang").count()
    assert got >= 0.95 * len(rows)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "123 --", "en"), (4, "words of one language", "en"), (4, "words of one language", "en"), (None, "more words", None), (6, None, "en")]
    df = labelled(spark, rows)
    model = langid.fit(df)
    out = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in langid.predict(df, model).collect()))
    assert out == [(0, "en", 1.0), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0), (4, "en", 1.0), (6, "und", 0.0)]
    empty = langid.fit(df.filter("doc_id = 1"))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    clash = df.selectExpr("*", "1 as score", "'q' as lang_pred", "7 as h", "8 as k", "9 as l", "2 as t")
    assert langid.predict(clash, langid.fit(clash)).filter("lang_pred = 'q'").count() == 0


def test_long_texts_are_read_whole():
    raw = np.frombuffer(("ab " * 600_000).encode(), np.uint8)
    tail = np.concatenate([raw, np.frombuffer(b" zyx" * 200_000, np.uint8)])
    assert float(langid.features(raw) @ langid.features(tail)) < 0.99
    assert float(np.linalg.norm(langid.features(tail))) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("ident", [None, 5])
def test_the_sample_is_bounded_whatever_the_ids(spark, ident):
    rows = [(ident, f"text number {i} of one language", "en") for i in range(3000)] + [(ident, f"wort nummer {i}", "de") for i in range(50)]
    got = langid.sample(labelled(spark, rows), 400, "text", "lang")
    assert [sum(lang == x for lang, _ in got) for x in ("de", "en")] == [50, 400]
    assert all(x.shape == (langid.DIMS,) for _, x in got)


def test_votes_against_brute_force():
    """The winner of all duels, by plain loops over the machines."""
    r = np.random.default_rng(5)
    names = ["a", "b", "c", "d"]
    model = langid.Discriminator({"f": names}, {(x, y): r.normal(size=langid.DIMS + 1).astype(np.float32) for i, x in enumerate(names) for y in names[i + 1 :]})
    for _ in range(50):
        x = r.normal(size=langid.DIMS).astype(np.float32) / 64
        wins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 1.0)
        for (p, q), w in model.machines.items():
            side = 1 / (1 + math.exp(-2 * max(-20, min(20, float(x @ w[:-1] + w[-1])))))
            wins[p if side >= 0.5 else q] += 1
            least[p], least[q] = min(least[p], side), min(least[q], 1 - side)
        best = sorted(names, key=lambda n: (-wins[n], -least[n]))[0]
        got = model.vote(names, x)
        assert got[0] == best and got[1] == pytest.approx(least[best], rel=1e-4)


def test_query_scores_are_those_of_single_texts(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs.filter(langid.fold("doc_id", 3) != 1))
    rows = {r.doc_id: (r.lang_pred, r.score) for r in queries.op10_language(spark, SMALL).collect()}
    assert rows == {d["doc_id"]: model.predict((d["text"] or "").encode()) for d in documents}
