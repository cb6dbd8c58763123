from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from tidegrid.llm import media, queries

from .conftest import SMALL


def by_hand(png: bytes) -> bytes:
    """Samples of an 8-bit grey picture, one byte at a time."""
    at, idat = 8, b""
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        if kind == b"IHDR":
            cols, rows = struct.unpack_from(">II", png, at + 8)
        if kind == b"IDAT":
            idat += png[at + 8 : at + 8 + n]
        at += n + 12
    raw, out = zlib.decompress(idat), []
    before = [0] * cols
    for r in range(rows):
        kind, *line = raw[r * (cols + 1) : (r + 1) * (cols + 1)]
        now = []
        for i, x in enumerate(line):
            a, b, c = (now[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((x + [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out += now
        before = now
    return bytes(out)


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_round_trip_of_each_written_filter(kind):
    x = np.random.default_rng(kind).integers(0, 256, (9, 64)).astype(np.uint8)
    png = media.png_encode(x, kind)
    assert (media.png_decode(png) == x).all() and by_hand(png) == x.tobytes()


@pytest.mark.parametrize("kinds", [[0, 1, 2, 3, 4], [3, 4], [3], [4]])
def test_all_filters_mixed(kinds):
    r = np.random.default_rng(3)
    lines = r.integers(0, 256, (40, 12)).astype(np.uint8)
    lines[:, 0] = r.choice(kinds, 40)
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 11, 40, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(lines.tobytes())) + media._chunk(b"IEND", b"")
    assert media.png_decode(png).tobytes() == by_hand(png)


def test_an_unknown_filter_is_an_error():
    with pytest.raises(ValueError):
        media.unfilter(np.array([0, 5], np.uint8), np.zeros((2, 4), np.uint8))


def test_damage_is_found():
    png = media.png_encode(np.zeros((2, 64), np.uint8))
    for bad in (b"GIF" + png[3:], png[:-3], png[:20] + b"\xff" + png[21:], png[:-12]):
        with pytest.raises(ValueError):
            media.png_decode(bad)


def test_query_round_trip(spark, documents):
    rows = {r.doc_id: r for r in queries.op5_media(spark, SMALL).collect()}
    same: dict[str, set] = {}
    for d in documents:
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        same.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())


def plain_hash(x):
    """The definition, sample by sample: means of 32 x 32 cells (or the sample they fall on), cosine sums, the median."""
    rows, cols = x.shape

    def part(i, n):
        a = i * n // 32
        return range(a, max(a + 1, (i + 1) * n // 32))

    small = [[np.mean([[x[r, c] for c in part(j, cols)] for r in part(i, rows)]) for j in range(32)] for i in range(32)]
    cos = [[math.cos(math.pi / 32 * (i + 0.5) * u) for i in range(32)] for u in range(8)]
    low = [round(sum(cos[u][i] * cos[v][j] * small[i][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    return "".join("1" if z > np.median(low[1:]) else "0" for z in low)


@pytest.mark.parametrize("rows", [1, 7, 31, 32, 33, 100])
def test_hash_is_the_definition(rows):
    x = np.random.default_rng(rows).integers(0, 256, (rows, 64)).astype(np.uint8)
    assert f"{int(media.cosine_hash(x), 16):064b}" == plain_hash(x)


def test_query_features_are_the_definition(spark, documents):
    rows = {r.doc_id: r.feature for r in queries.op5_media(spark, SMALL).collect()}
    for d in documents[::20]:
        raw = (d["text"] or "").encode()
        x = np.frombuffer(raw + bytes(-len(raw) % 64 or (0 if raw else 64)), np.uint8).reshape(-1, 64)
        assert f"{int(rows[d['doc_id']], 16):064b}" == plain_hash(x)


def test_hash_is_close_for_like_pictures():
    coarse = np.random.default_rng(7).integers(60, 196, (8, 8))
    a = np.kron(coarse, np.ones((8, 8))).astype(np.uint8)  # energy in all low frequencies
    noisy = np.clip(a + np.random.default_rng(1).integers(-6, 7, a.shape), 0, 255).astype(np.uint8)
    other = np.random.default_rng(2).integers(0, 256, a.shape).astype(np.uint8)
    bits = [int(media.cosine_hash(z), 16) for z in (a, noisy, other)]
    assert (bits[0] ^ bits[1]).bit_count() <= 12 < (bits[0] ^ bits[2]).bit_count()


def test_nulls_empty_tables_and_clashing_names(frame):
    out = media.decode(media.encode(frame([(1, None), (2, ""), (None, "é"), (2, "")]))).collect()
    assert sorted((r.n_bytes, r.payload) for r in out) == [(0, bytes(64))] * 3 + [(2, "é".encode() + bytes(62))]
    assert media.decode(media.encode(frame([]))).count() == 0
    stored = media.encode(frame([(1, "a")])).selectExpr("doc_id", "media", "5 as payload", "6 as feature", "'k' as kept")
    assert media.decode(stored).first().kept == "k"
    nothing = media.encode(frame([(1, "a")])).selectExpr("doc_id", "cast(null as binary) as media")
    assert media.decode(nothing).first().payload is None


def test_stored_lines_are_filtered(frame):
    for r in media.encode(frame([(1, "some text " * 50), (2, None)])).collect():
        idat = b"".join(body for kind, body in media.png_chunks(bytes(r.media)) if kind == b"IDAT")
        assert set(zlib.decompress(idat)[:: media.WIDTH + 1]) == {2}
