from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import bpe, queries

from .conftest import ODD_TEXTS, SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_odd_texts_as_the_library(library):
    got = bpe.word_bpe(PATH).encode(ODD_TEXTS)
    for text, ids in zip(ODD_TEXTS, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected(library, text), text
        assert bpe.word_bpe(PATH).decode(ids).decode() == library.decode(expected(library, text), skip_special_tokens=False)


def test_ties_merge_from_the_left():
    table = bpe.MergeTable({c: i for i, c in enumerate(bpe.byte_alphabet())} | {"aa": 256, "aab": 257}, ["a a", "aa b"])
    ids, off = table.encode([b"aaa", b"aaaab", b"", b"b"])
    a, b = 97, 98
    assert [ids[x:y].tolist() for x, y in zip(off, off[1:], strict=False)] == [[256, a], [256, 257], [], [b]]


def test_query_as_the_library(spark, library, documents):
    rows = {r.doc_id: r for r in queries.op1_bpe(spark, SMALL).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        ids = expected(library, d["text"])
        r = rows[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(spark, frame):
    out = bpe.decode(bpe.encode(frame([(1, None), (1, None), (None, "hello world"), (3, "")]), PATH), PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.ids), r.decoded) for r in out)[1:] == [(1, b"", ""), (1, b"", ""), (3, b"", "")]
    assert bpe.decode(bpe.encode(frame([]), PATH), PATH).count() == 0
    clash = frame([(1, "hello")]).selectExpr("doc_id", "text", "1 as ids", "2 as decoded", "3 as t")
    assert bpe.encode(clash, PATH).columns == ["doc_id", "ids"]


def test_round_trip_is_both_ways_and_the_store_is_bounded(frame, prose, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, *(prose(k, 3000, 10**6) for k in range(6)), "é" * 100_000])]
    want = sorted(map(tuple, bpe.decode(bpe.encode(frame(rows), path), path).collect()))
    assert sorted(map(tuple, bpe.round_trip(frame(rows), path).collect())) == want
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 1000)
    one = bpe.WordBpe(path)
    for i, t in rows:
        assert one.encode([t])[0] == bytes(want[i][1])
        assert one.held <= 1000 + 10 * len((t or "").encode())
