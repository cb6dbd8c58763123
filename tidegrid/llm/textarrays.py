"""Texts as flat arrays: words, word hashes and shingle hashes without per-word Python.

A chunk of documents is one UTF-8 buffer with document offsets, as Arrow holds
it.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never
uses those bytes inside a longer sequence, so splitting bytes equals splitting
characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_NONSPACE = ~_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLES = {0: _odd(11, 256), 1: _odd(12, 256)}
_BASE = {0: np.uint64(0x9E3779B97F4A7C15 | 1), 1: np.uint64(0xC2B2AE3D27D4EB4F | 1)}
_INV = {k: np.uint64(pow(int(v), -1, 1 << 64)) for k, v in _BASE.items()}
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(seed: int, inverse: bool, n: int) -> np.ndarray:
    """base**0..base**(n-1) modulo 2**64; grown by doubling and kept up to 1 MiB of text."""
    key = (seed, inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(CHUNK_BYTES, 1 << (n - 1).bit_length() if n > 1 else 1)
        base = int((_INV if inverse else _BASE)[seed])
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if size <= 4 * CHUNK_BYTES:
            _POWERS[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the splitmix one), a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """Some whole documents: rows of the batch first..first+n, their bytes and offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of whole documents, about ``limit`` bytes each (a longer document is its own chunk)."""
    raw, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        data = raw[offsets[first] : offsets[last]]
        yield Chunk(first, LOWER[data] if lower else data, offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    docs: np.ndarray  # offsets of each document's words

    @property
    def n(self) -> int:
        return len(self.start)


def words(c: Chunk) -> Words:
    n = len(c.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(c.offsets), np.int64))
    ns = _NONSPACE[c.data]
    starts, ends = ns.copy(), ns.copy()
    starts[1:] &= ~ns[:-1]
    ends[:-1] &= ~ns[1:]
    inner = c.offsets[(c.offsets > 0) & (c.offsets < n)]
    starts[inner] = ns[inner]
    ends[inner - 1] = ns[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(s, e, np.searchsorted(s, c.offsets, "left"))


def word_hashes(c: Chunk, w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes: differences of a running polynomial sum."""
    if not w.n:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(c.data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLES[seed][c.data] * _powers(seed, False, len(c.data)), out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * _powers(seed, True, len(c.data))[w.start]
    return mix(h + (w.end - w.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position on (n-k+1 of them; across documents too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : j + n]
    return mix(out)


def sequence_hash(h: np.ndarray) -> int:
    """The hash of one whole word sequence shorter than a shingle, told apart by its length."""
    out = 0x2545F4914F6CDD1D + len(h)
    for x in h.tolist():
        out = (out * int(_STEP) + x) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([out], np.uint64))[0])


def within(docs: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n window starts lie wholly inside one document; docs: word offsets."""
    ok = np.ones(n, bool)
    for b in docs[1:-1].tolist():
        ok[max(0, b - k + 1) : b] = False
    return ok
