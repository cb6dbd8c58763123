from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import queries, tokenfile

from .conftest import ODD_TEXTS, SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_odd_texts_as_the_library(library):
    for text, ids in zip(ODD_TEXTS, tokenfile.byte_bpe(PATH).encode(ODD_TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_query_as_the_library(spark, library, documents):
    rows = {r.doc_id: r for r in queries.op4_token_file(spark, SMALL).collect()}
    start = 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = rows[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("top", [1, 2, 300, 70_000])
def test_wavelet_matrix(top, stored):
    ids = np.random.default_rng(top).integers(0, top, 500)
    wm = tokenfile.unpack(tokenfile.pack([1], np.array([500]), ids))[2] if stored else tokenfile.WaveletMatrix.build(ids)
    assert wm.tokens().tolist() == ids.tolist()
    assert [wm.access(i) for i in range(500)] == ids.tolist()
    for token in [*ids[:5].tolist(), top, 2 * top + 1]:
        at = np.flatnonzero(ids == token).tolist()
        assert wm.count(token) == len(at)
        assert [wm.rank(token, i) for i in (0, 1, 77, 500, 600)] == [sum(x < i for x in at) for i in (0, 1, 77, 500, 600)]
        assert [wm.select(token, k) for k in range(len(at) + 1)] == [*at, -1]
    with pytest.raises(IndexError):
        wm.access(500)


@pytest.mark.parametrize("n", [0, 511, 512, 513, 32_768, 32_769, 100_000])
def test_directories_at_the_edges_of_lines_and_blocks(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.5, 3, r.integers(0, 6, n))
    ids[n // 3 : n // 2] = 5
    _, _, wm = tokenfile.unpack(tokenfile.pack([1], np.array([n]), ids))
    assert wm.tokens().tolist() == ids.tolist()
    for token in range(7):
        at = np.flatnonzero(ids == token)
        for i in {0, 1, n // 2, 511, 512, 513, 32_767, 32_768, 32_769, n - 1, n}:
            assert wm.rank(token, i) == (at < i).sum()
            assert i >= n or i < 0 or wm.access(i) == ids[i]
        for k in {0, 1, len(at) // 3, len(at) // 2, len(at) - 1, len(at)}:
            assert wm.select(token, k) == (at[k] if 0 <= k < len(at) else -1)


def test_one_access_opens_one_block_a_plane():
    n = 200_000
    _, _, wm = tokenfile.unpack(tokenfile.pack([1], np.array([n]), np.random.default_rng(1).integers(0, 50_000, n)))
    wm.access(150_000)
    assert [len(p.held) for p in wm.planes] == [1] * wm.levels and wm.planes[0].before[-1] > 0


def test_packed_shards_are_checked():
    ids = np.array([5, 6, 5, 2], "<u4")
    raw = tokenfile.pack([3, None], np.array([3, 1]), ids)
    docs, lengths, wm = tokenfile.unpack(raw)
    assert (docs, lengths.tolist(), wm.tokens().tolist()) == ([3, None], [3, 1], ids.tolist())
    for i in range(len(raw)):
        with pytest.raises(ValueError):
            tokenfile.unpack(raw[:i] + bytes([raw[i] ^ 255]) + raw[i + 1 :])[2].tokens()
    for bad in (b"XXXX" + raw[4:], b"TG", b""):
        with pytest.raises(ValueError):
            tokenfile.unpack(bad)


def test_shards_across_documents(spark, frame, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_TOKENS", 50)
    rows = [(i, "word " * (i % 40)) for i in range(60)] + [(7, "again"), (None, "no id"), (70, None)]
    shards = tokenfile.write(frame(rows), PATH)
    out = tokenfile.read(shards).join(tokenfile.starts(shards), ["part", "seq"]).collect()
    out.sort(key=lambda r: r.base + r.local)
    assert [r.base + r.local for r in out] == np.cumsum([0, *[r.n_tokens for r in out]])[:-1].tolist()
    assert [r.doc_id for r in out] == [None, *sorted(i for i, _ in rows if i is not None)]
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 2 for r in out)
    assert tokenfile.read(tokenfile.write(frame([]), PATH)).count() == 0


def test_lookup_against_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_TOKENS", 50)
    rows = [(i, "red word " * (i % 40) + "blue" * (i % 3)) for i in range(60)] + [(7, "red red"), (None, "red"), (70, None)]
    shards = tokenfile.write(frame(rows), PATH)
    for token in {2, 60_000, *np.frombuffer(tokenfile.byte_bpe(PATH).encode(["red word red blue"])[0], "<u4").tolist()}:
        want = []
        for r in tokenfile.read(shards).collect():
            at = np.flatnonzero(np.frombuffer(r.ids, "<u4") == token).tolist()
            want += [(r.part, r.seq, r.doc_id, len(at), at[0], at[-1])] if at else []
        assert sorted(map(tuple, tokenfile.lookup(shards, token).collect()), key=str) == sorted(want, key=str), token


def test_lookup_query_against_the_library(spark, library, documents):
    token, want = library.encode(" the", add_special_tokens=False).ids[0], []
    for d in documents:
        at = [i for i, x in enumerate(library.encode(d["text"] or "", add_special_tokens=False).ids) if x == token]
        want += [(d["doc_id"], len(at), at[0], at[-1])] if at else []
    assert want and sorted(map(tuple, queries.token_lookup(spark, SMALL).collect())) == sorted(want)


def test_clashing_columns_and_a_long_text(frame):
    text = "long text, " * 60_000  # its shard has more ids than the others may
    df = frame([(1, text), (2, "short")]).selectExpr("doc_id", "text", "1 as i", "2 as t", "3 as part", "4 as payload", "5 as ids")
    out = {r.doc_id: r for r in tokenfile.read(tokenfile.write(df, PATH)).collect()}
    assert np.frombuffer(out[1].ids, "<u4").tolist() == [*np.frombuffer(tokenfile.byte_bpe(PATH).encode([text])[0], "<u4").tolist(), 2]
    assert out[1].n_tokens > 180_000 and set(out) == {1, 2}
