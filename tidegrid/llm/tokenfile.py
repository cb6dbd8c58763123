"""Token files: one wavelet matrix per shard of a corpus (operator 4).

``encode`` turns texts into ids with the byte-level vocabulary; ``write`` puts
the ids of all documents, in ascending document order, into shards.  A shard is
one compressed payload: bit-planes of its ids, most significant bit first, each
plane ordered by a stable partition on the plane above.  Planes are cut into blocks
that are compressed one by one; the counts of set bits before each block and before
each line of a block are stored with them.  From that alone ``WaveletMatrix`` answers
access(i), rank(id, i) (occurrences before i), count and select(id, k) (place of the
k-th occurrence), decompressing only the blocks that lie on the way.  ``lookup`` asks
all shards where an id occurs.

Shards are rows of a Parquet table in the shared folder, so that any executor
can read what another wrote.  Documents never cross shards; a longer document
has a shard to itself.

Cases: null text: no ids but the end id; empty corpus: no shards; equal
document ids stay together, in order of their texts; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import MEMORY_WORDS, MergeTable
from .session import written
from .textarrays import Chunk, Words, chunks, word_hashes, words

MAGIC = b"TGWM"
#: Ids in a shard before it is closed.
SHARD_TOKENS = 1 << 18
#: Bytes of a plane in a block, compressed by itself, and in a line of its directory.
BLOCK_BYTES, LINE_BYTES = 1 << 12, 64
LINES = BLOCK_BYTES // LINE_BYTES
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes that may begin a special token or white space beyond the ASCII one, and what does.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(0x1C, 0x20), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD = re.compile(rb"<\||[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LEADS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class IdTable:
    """Lists of ids under 64-bit keys, in arrays: open addressing, found and filled many at once."""

    def __init__(self, bits: int = 22):
        self.bits, self.most = bits, 1 << (bits - 1)
        self.keys, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.off, self.flat, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key (not 0); -1 where there is none."""
        at = self.home(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.entry[at], -1)
        left = np.flatnonzero((got != keys) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.entry[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def put(self, keys: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Add distinct keys that are not there."""
        base, n = int(self.off[self.n]), len(keys)
        while len(self.off) < self.n + n + 1:
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while len(self.flat) < base + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.off[self.n + 1 : self.n + n + 1] = base + np.cumsum(lengths)
        self.flat[base : base + len(flat)] = flat
        at, left = self.home(keys), np.arange(n)
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.entry[at[won]] = keys[won], self.n + won
            placed = np.zeros(n, bool)
            placed[won] = True
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.n += n

    def lists(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries in order, how many each has)."""
        start = self.off[entries]
        n = self.off[entries + 1] - start
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(start - ends + n, n)], n


class ByteBpe:
    """The byte-level vocabulary over the same merge rounds as the word-end one.

    Words with one space or line end between them are looked up by hash, without a
    Python object each: the pattern never looks beyond such a word and the space
    before it.  Texts with other white space or special tokens go piece by piece.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = MergeTable(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pattern = regex.compile(PATTERN)
        self.words = IdTable()
        self.raw: dict[str, bytes] = {}  # pieces of the pattern itself
        self.line_end = self.table.encode([b"\n"])[0]

    def learn(self, keys: np.ndarray, words: list[str], lead: np.ndarray) -> None:
        """Words after nothing (lead 0), a space (1) or a line end (2, whose id goes with the word)."""
        if self.words.n + len(keys) > self.words.most:
            self.words = IdTable(max(self.words.bits, len(keys).bit_length() + 1))
        pieces = self.pattern.findall("\n".join([" " + w if x == 1 else w for w, x in zip(words, lead.tolist(), strict=True)]))
        names = list(set(pieces))
        ids, off = self.table.encode([w.encode() for w in names])
        place = dict(zip(names, range(len(names)), strict=True))
        which = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        cut = which == place.get("\n", -1)
        n = np.where(cut, 0, np.diff(off)[which])
        ends = np.cumsum(n)
        flat = ids[np.arange(int(n.sum())) + np.repeat(off[which] - ends + n, n)]
        bounds = np.concatenate([[0], ends[cut], [len(flat)]])
        after = lead == 2
        flat = np.insert(flat, bounds[:-1][after], self.line_end[0])
        self.words.put(keys, flat, np.diff(bounds) + after)

    def by_pieces(self, text: str) -> bytes:
        out = []
        for part in self.cut.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                pieces = self.pattern.findall(part)
                if new := list(set(pieces).difference(self.raw)):
                    ids, off = self.table.encode([k.encode() for k in new])
                    raw, at = ids.astype("<u4").tobytes(), (off * 4).tolist()
                    self.raw.update(zip(new, map(raw.__getitem__, map(slice, at, at[1:])), strict=True))
                out.extend(map(self.raw.__getitem__, pieces))
        if len(self.raw) > MEMORY_WORDS:
            self.raw.clear()
        return b"".join(out)

    def odd(self, c: Chunk, w: Words, sep: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Documents that have anything but single spaces and line ends between their words."""
        docs, off = w.docs, c.offsets
        has = np.diff(docs) > 0
        out = ~has & (np.diff(off) > 0)
        out[has] |= (w.start[docs[:-1][has]] != off[:-1][has]) | (w.end[docs[1:][has] - 1] != off[1:][has])
        bad = ~first & (sep != 32) & (sep != 10)
        bad[1:] |= ~first[1:] & (w.start[1:] - w.end[:-1] != 1)
        out[np.searchsorted(docs, np.flatnonzero(bad), "right") - 1] = True
        at = np.flatnonzero(_SUSPECT[c.data])
        for i in np.unique(np.searchsorted(off, at, "right") - 1).tolist():
            if not out[i]:
                out[i] = _ODD.search(c.data[off[i] : off[i + 1]].tobytes()) is not None
        return out

    def encode_chunk(self, c: Chunk) -> list[bytes]:
        w = words(c)
        first = np.zeros(w.n, bool)
        first[w.docs[:-1][np.diff(w.docs) > 0]] = True
        sep = c.data[np.maximum(w.start - 1, 0)] if w.n else np.zeros(0, np.uint8)
        odd = self.odd(c, w, sep, first)
        lead = np.where(first, 0, np.where(sep == 10, 2, 1))
        keys = word_hashes(c, w) ^ _LEADS[lead]
        keys[keys == 0] = 1
        if odd.any():
            use = np.flatnonzero(~np.repeat(odd, np.diff(w.docs)))
            keys, lead, start, end = keys[use], lead[use], w.start[use], w.end[use]
        else:
            start, end = w.start, w.end
        entries = self.words.find(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            fresh, i = np.unique(keys[new], return_index=True)
            i = new[i]
            raw = c.data.tobytes()
            held = self.words
            self.learn(fresh, [raw[a:b].decode() for a, b in zip(start[i].tolist(), end[i].tolist(), strict=True)], lead[i])
            if self.words is not held:  # the table began anew
                return self.encode_chunk(c)
            entries[new] = self.words.find(keys[new])
        flat, n = self.words.lists(entries)
        cut = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(w.docs)))])] * 4
        raw, at = flat.astype("<u4").tobytes(), cut.tolist()
        out = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        for d in np.flatnonzero(odd).tolist():
            out[d] = self.by_pieces(c.data[c.offsets[d] : c.offsets[d + 1]].tobytes().decode())
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        return [x for c in chunks(column) for x in self.encode_chunk(c)]


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class Plane:
    """One bit-plane in blocks of BLOCK_BYTES, each with its own directory of counts; a block is fetched when it is asked for."""

    def __init__(self, before: np.ndarray, fetch: Callable[[int], bytes]):
        self.before, self.fetch = before, fetch  # set bits before each block, and in all
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(set bits of the block before each of its lines, its bytes)."""
        if b not in self.held:
            raw = self.fetch(b)
            self.held[b] = np.frombuffer(raw, "<u2", LINES), np.frombuffer(raw, np.uint8, offset=2 * LINES)
        return self.held[b]

    def bit(self, i: int) -> int:
        b, i = divmod(i, 8 * BLOCK_BYTES)
        return int(self.block(b)[1][i >> 3]) >> (7 - (i & 7)) & 1

    def ones(self, i: int) -> int:
        """Set bits before place i: the counts before its block and before its line, and one partial line."""
        b, i = divmod(i, 8 * BLOCK_BYTES)
        if not i:
            return int(self.before[b])
        counts, data = self.block(b)
        line, rest = divmod(i - 1, 8 * LINE_BYTES)
        part = int.from_bytes(data[line * LINE_BYTES : (i + 7) // 8].tobytes(), "big") >> (-i & 7)
        return int(self.before[b]) + int(counts[line]) + part.bit_count()

    def place(self, k: int, one: int) -> int:
        """Place of the k-th (from 0) bit of a value that has so many."""
        width = 8 * BLOCK_BYTES
        before = self.before if one else np.arange(len(self.before)) * width - self.before
        # the last entry counts what the last block lacks too, which no bit asked for lies in
        b = int(np.searchsorted(before[:-1], k, "right")) - 1
        counts, data = self.block(b)
        own = counts.astype(np.int64) if one else np.arange(LINES) * (8 * LINE_BYTES) - counts
        line = int(np.searchsorted(own, k - before[b], "right")) - 1
        bits = np.unpackbits(data[line * LINE_BYTES : (line + 1) * LINE_BYTES])
        return b * width + line * 8 * LINE_BYTES + int(np.flatnonzero(bits == one)[int(k - before[b] - own[line])])

    def all(self) -> np.ndarray:
        return np.concatenate([self.block(b)[1] for b in range(len(self.before) - 1)])


class WaveletMatrix:
    """Bit-planes of a sequence with rank and select."""

    def __init__(self, planes: list[Plane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.levels = planes, zeros, n, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        levels = max(1, top.bit_length())
        x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (x >> x.dtype.type(level)) & x.dtype.type(1) != 0
            planes.append(_in_blocks(np.packbits(bit)))
            low = x[~bit]
            zeros.append(len(low))
            x = np.concatenate([low, x[bit]])
        return cls(planes, zeros, len(ids))

    def tokens(self) -> np.ndarray:
        """The whole sequence: undo the partitions from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for i in range(self.levels - 1 if self.n else -1, -1, -1):
            bit, z = np.unpackbits(self.planes[i].all(), count=self.n).view(bool), self.zeros[i]
            up = np.empty_like(x)
            up[~bit] = x[:z]
            up[bit] = x[z:] | x.dtype.type(1 << (self.levels - 1 - i))
            x = up
        return x

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, ones = plane.bit(i), plane.ones(i)
            i = zeros + ones if one else i - ones
            value = value << 1 | one
        return value

    def span(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of token before place i stand below the last plane."""
        lo, hi = 0, max(0, min(i, self.n))
        if token < 0 or token >> self.levels:
            return 0, 0
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            if lo == hi:
                break
            a, b = plane.ones(lo), plane.ones(hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before place i."""
        lo, hi = self.span(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token; -1 if there are fewer. One walk down the planes and one up."""
        lo, hi = self.span(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self.planes[level].place(at - self.zeros[level] if one else at, one)
        return at


def _in_blocks(data: np.ndarray) -> Plane:
    """A plane and its directories."""
    n = -(-len(data) // BLOCK_BYTES)
    whole = np.zeros(n * BLOCK_BYTES, np.uint8)
    whole[: len(data)] = data
    lines = np.bitwise_count(whole.view("<u8")).reshape(n, LINES, LINE_BYTES // 8).sum(2, dtype=np.int64)
    sums = np.cumsum(lines, 1)
    counts = (sums - lines).astype("<u2")
    before = np.concatenate([[0], np.cumsum(sums[:, -1])]) if n else np.zeros(1, np.int64)
    blocks = whole.reshape(n, BLOCK_BYTES)
    return Plane(before, lambda b: counts[b].tobytes() + blocks[b].tobytes())


#: Magic, documents, ids, planes, blocks of a plane, bytes of the documents' part, its crc32; then crc32 of these and the index.
HEADER = struct.Struct("<4sIIHIII")


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's payload: header, index of the blocks, documents, blocks.

    The index holds the zeros of each plane and, for each block, the set bits before it, where it ends and its crc32.
    """
    wm = WaveletMatrix.build(ids)
    squeeze = zstandard.ZstdCompressor(1).compress
    nulls = np.array([d is None for d in doc_ids], bool)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    about = squeeze(docs.tobytes() + np.packbits(nulls).tobytes() + lengths.astype("<u4").tobytes())
    per_plane = len(wm.planes[0].before) - 1
    blocks = [squeeze(p.fetch(b)) for p in wm.planes for b in range(per_plane)]
    index = np.array(wm.zeros, "<u4").tobytes() + np.array([p.before for p in wm.planes], "<u4").tobytes()
    index += np.cumsum([0, *map(len, blocks)]).astype("<u4").tobytes() + np.array([*map(zlib.crc32, blocks)], "<u4").tobytes()
    head = HEADER.pack(MAGIC, len(doc_ids), wm.n, wm.levels, per_plane, len(about), zlib.crc32(about))
    return head + struct.pack("<I", zlib.crc32(head + index)) + index + about + b"".join(blocks)


def _checked(raw: memoryview, crc: int) -> memoryview:
    if zlib.crc32(raw) != crc:
        raise ValueError("a damaged token shard")
    return raw


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Documents, their lengths and the matrix, of which blocks are decompressed as they are asked for."""
    if len(payload) < HEADER.size + 4 or payload[:4] != MAGIC:
        raise ValueError("not a token shard")
    view = memoryview(payload)
    _, n_docs, n, levels, per_plane, size, docs_crc = HEADER.unpack_from(payload)
    total = levels * per_plane
    since = HEADER.size + 4
    at = since + 4 * (levels + levels * (per_plane + 1) + total + 1 + total)
    if zlib.crc32(view[since:at], zlib.crc32(view[: HEADER.size])) != struct.unpack_from("<I", payload, HEADER.size)[0]:
        raise ValueError("a damaged token shard")
    index = np.frombuffer(view[since:at], "<u4").astype(np.int64)
    zeros, before, ends, crcs = np.split(index, np.cumsum([levels, levels * (per_plane + 1), total + 1]))
    expand = zstandard.ZstdDecompressor().decompress
    body = expand(_checked(view[at : at + size], docs_crc))
    bits = (n_docs + 7) // 8
    docs = np.frombuffer(body, "<i8", n_docs)
    nulls = np.unpackbits(np.frombuffer(body, np.uint8, bits, 8 * n_docs), count=n_docs).astype(bool)
    lengths = np.frombuffer(body, "<u4", n_docs, 8 * n_docs + bits).astype(np.int64)
    blocks = view[at + size :]

    def plane(level: int) -> Plane:
        def fetch(b: int) -> bytes:
            i = level * per_plane + b
            return expand(_checked(blocks[ends[i] : ends[i + 1]], int(crcs[i])))

        return Plane(before[level * (per_plane + 1) : (level + 1) * (per_plane + 1)], fetch)

    return [None if z else int(d) for d, z in zip(docs, nulls, strict=True)], lengths, WaveletMatrix([plane(i) for i in range(levels)], zeros.tolist(), n)


SHARDS = "part int, seq int, n_docs int, n_tokens long, payload binary"


def write(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode df and write it as shards in ascending id order; returns the table of shards as written.

    One shuffle: texts are dealt by ranges of the id.  Memory: one shard and one Arrow batch a task.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seq = byte_bpe(path), TaskContext.get().partitionId(), 0
        end = np.uint32(end_id).tobytes()
        docs: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            row = [[part], [seq], [len(docs)], [len(ids)], [pack(docs, lengths, ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["part", "seq", "n_docs", "n_tokens", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            ident = b.column(0)
            for c in chunks(b.column(1)):
                for doc, ids in zip(ident[c.first : c.first + c.n_docs].to_pylist(), bpe.encode_chunk(c), strict=True):
                    if docs and n + len(ids) // 4 + 1 > SHARD_TOKENS:
                        yield close()
                        docs, held, n, seq = [], [], 0, seq + 1
                    docs.append(doc)
                    held.append(ids + end)
                    n += len(ids) // 4 + 1
        if docs:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    dealt = rows.repartitionByRange("i").sortWithinPartitions("i", "t")
    return written(dealt.mapInArrow(run, SHARDS), "token-shards")


def starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids in all shards before each.

    The driver sees one total for each writing task, never one for each document or shard.
    """
    spark = shards.sparkSession
    small = shards.select("part", "seq", "n_tokens")
    base, bases = 0, []
    for part, total in sorted((r[0], r[1]) for r in small.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases.append((part, base))
        base += total
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = small.select("part", "seq", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("own"))
    parts = spark.createDataFrame(bases, "part int, before long")
    return own.join(F.broadcast(parts), "part").select("part", "seq", (F.col("own") + F.col("before")).alias("base"))


READ = "part int, seq int, doc_id long, local long, n_tokens long, ids binary"


def read(shards: DataFrame) -> DataFrame:
    """Every document of the shards with its ids (binary, little-endian 32-bit), read from the bit-planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                docs, lengths, wm = unpack(payload)
                ids = wm.tokens().astype("<u4")
                off = np.concatenate([[0], np.cumsum(lengths)])
                n = len(docs)
                data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(off[:-1]), pa.array(lengths), data], names=["part", "seq", "doc_id", "local", "n_tokens", "ids"])

    return shards.select("part", "seq", "payload").mapInArrow(run, READ)


FOUND = "part int, seq int, doc_id long, n long, first long, last long"


def lookup(shards: DataFrame, token: int) -> DataFrame:
    """(part, seq, doc_id, n, first, last): documents that have the id, how often, and its first and last place in them.

    By rank and select on the stored planes: no document is decoded, and a shard without the id costs a few blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for b in batches:
            for part, seq, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                docs, lengths, wm = unpack(payload)
                ends, rows, k, total = np.cumsum(lengths), [], 0, wm.count(token)
                while k < total:
                    first = wm.select(token, k)
                    i = int(np.searchsorted(ends, first, "right"))
                    start, upto = int(ends[i] - lengths[i]), wm.rank(token, int(ends[i]))
                    rows.append((part, seq, docs[i], upto - k, first - start, wm.select(token, upto - 1) - start))
                    k = upto
                cols = zip(*rows, strict=True) if rows else [[]] * len(names)
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return shards.select("part", "seq", "payload").mapInArrow(run, FOUND)
