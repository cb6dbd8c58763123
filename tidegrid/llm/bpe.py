"""Byte-pair encoding by batched numpy merge rounds (operator 1).

The symbols of many distinct words lie in one flat array.  A round looks up
every adjacent pair by binary search over the sorted pair keys of the merge
list, finds the lowest rank of each word, and merges that pair wherever it
occurs in the word, left to right.  Words without a pair left drop out, so
rounds shrink fast.  Words seen before in a worker are not merged again.

Vocabulary files are those of the ``tokenizers`` library (JSON); the path is a
parameter and must be readable on every worker.

Cases: a null text is an empty one (no ids, decoded ""); ties between equal
pairs go to the left; repeated rows are encoded each; other columns of the
input are passed through (``keep``) or left out, never read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words kept merged by a worker, and the bytes of their texts and ids; past either the store starts anew.
MEMORY_WORDS = 200_000
MEMORY_BYTES = 16 << 20
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class MergeTable:
    """Merges as sorted pair keys; encodes many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.base = max(vocab.values()) + 1
        alphabet = byte_alphabet()
        self.first = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the offsets of each word's ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(lengths)
        if self.last is not self.first and len(ends):
            full = ends[lengths > 0] - 1
            sym[full] = self.last[raw[full]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word, none = [], [], np.int32(len(self.keys))
        sym, word = sym.astype(np.int32), word.astype(np.int32)
        last = np.ones(len(word), bool)  # a word's last symbol begins no pair
        last[:-1] = word[1:] != word[:-1]
        at, rank = self.find(sym, np.flatnonzero(~last), len(sym), none)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            counts = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            low_of = np.repeat(low, counts)
            alive = low_of < none
            pos = np.flatnonzero((rank == low_of) & alive)
            keep = alive
            if len(pos) < len(low) or not alive.all():
                out = ~alive
                done_sym.append(sym[out])
                done_word.append(word[out])
            if not len(pos):
                break
            run = np.concatenate([[True], np.diff(pos) > 1])
            head = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - head) % 2 == 0]  # in "aaa" the left pair wins
            sym[pos] = self.made[at[pos]]
            last[pos] = last[pos + 1]
            keep[pos + 1] = False
            moved = (np.cumsum(keep) - 1)[pos]
            sym, word, last, at, rank = sym[keep], word[keep], last[keep], at[keep], rank[keep]
            # only the pairs beside a merged symbol are new
            before = moved[moved > 0] - 1
            new = np.concatenate([moved[~last[moved]], before[~last[before]]])
            rank[moved] = none
            at[new], rank[new] = self.look(sym[new], sym[new + 1], none)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        ids, of = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(of, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def look(self, left: np.ndarray, right: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """Place among the sorted keys and rank (none: no such merge) of each pair."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == none] = 0
        return at, np.where(self.keys[at] == key, self.ranks[at], none).astype(np.int32)

    def find(self, sym: np.ndarray, pos: np.ndarray, n: int, none: int) -> tuple[np.ndarray, np.ndarray]:
        at, rank = np.zeros(n, np.int64), np.full(n, none, np.int32)
        at[pos], rank[pos] = self.look(sym[pos], sym[pos + 1], none)
        return at, rank


class WordBpe:
    """The word-end vocabulary: NFC, lower case, pattern split, merges with a word-end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.table = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"] + r"|\n")
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """Stretches between white space, and special tokens, of one text in order.

        No alternative of the pattern crosses white space, nor does NFC or lower case, so a
        stretch has the same ids wherever it stands.
        """
        if self.cut is None or "<|" not in text:
            return self.stretches(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.stretches(part)
        return out

    def stretches(self, text: str) -> list[str]:
        if ODD_SPACE.search(text):  # str.split() takes these for white space, the pattern does not
            return SPACE.split(text)
        return text.split()

    def split(self, text: str) -> list[str]:
        """Normalized words, and a line end for each line end."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes letter by letter here: no final sigma
                text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def learn(self, new: list[str]) -> None:
        """Encode stretches not met before: their words once each, then put together by array moves."""
        words = self.split("\n".join(new))
        names = sorted(set(words))
        ids, off = self.table.encode([w.encode() for w in names])
        place = dict(zip(names, range(len(names)), strict=True))
        which = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        size = off[1:] - off[:-1]
        cut = which == place.get("\n", -1)
        n = np.where(cut, 0, size[which])
        ends = np.cumsum(n)
        flat = ids[np.arange(int(n.sum())) + np.repeat(off[which] - ends + n, n)]
        bounds = np.concatenate([[0], ends[cut], [len(flat)]]) * 4
        raw, at = flat.astype("<u4").tobytes(), bounds.tolist()
        self.held += len(raw) + sum(map(len, new))
        self.known.update(zip(new, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        lists = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > MEMORY_WORDS or self.held > MEMORY_BYTES:
            self.known.clear()
            self.held = 0
        if not self.known:
            self.known = {t: int(i).to_bytes(4, "little") for t, i in self.special.items()}
        new = set().union(*lists).difference(self.known)
        if new:
            self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, x)) for x in lists]

    def decode(self, ids: bytes) -> bytes:
        """The file names no decoder: tokens joined by one space, in UTF-8."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def parts_of(column: pa.Array, most: int = 4 << 20) -> Iterator[slice]:
    """Row slices of about ``most`` bytes of text, one row at least."""
    off = column.cast(pa.large_string()).buffers()[1] if len(column) else None
    if off is None:
        return
    off = np.frombuffer(off, np.int64, len(column) + 1)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield slice(at, min(to, len(column)))
        at = to


def _encoder(path: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            b = pa.record_batch([b.column(0), b.column(1).fill_null("") if b.num_rows else b.column(1)], names=["i", "t"])
            for s in parts_of(pa.concat_arrays([b.column(1)])):
                part = b.slice(s.start, s.stop - s.start)
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return run


def _decoder(path: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = [bpe.decode(x or b"") for x in part.column(1).to_pylist()]
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.record_batch([part.column(0), part.column(1), text], names=[id_col, "ids", "decoded"])

    return run


_IDS, _DECODED = T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each text's ids as little-endian 32-bit integers. No shuffle."""
    return df.select(id_col, text_col).mapInArrow(_encoder(path, id_col), T.StructType([df.schema[id_col], _IDS]))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string) of encoded rows; null ids decode as empty. No shuffle."""
    return df.select(id_col, ids_col).mapInArrow(_decoder(path, id_col), T.StructType([df.schema[id_col], _IDS, _DECODED]))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded, then decoded from the ids, as decode(encode(df)) but by one worker a task, which holds one vocabulary."""
    first, second = _encoder(path, id_col), _decoder(path, id_col)
    return df.select(id_col, text_col).mapInArrow(lambda batches: second(first(batches)), T.StructType([df.schema[id_col], _IDS, _DECODED]))
