"""Repeated spans of words across documents, and their removal (operator 2).

The corpus is a De Bruijn graph: nodes are 12-word sequences, edges the 13-word
windows.  An edge matters if it occurs in two documents.

1. Each window has a minimizer, the least hash of its nine 5-word sequences; equal
   windows have equal minimizers.  Blocks of documents list their distinct
   minimizers, and an exchange tells which occur in other documents too.
2. Only windows with such a minimizer are listed as edges; a second exchange tells
   which edges are repeated.
3. Repeated edges that follow one another in a document make a run.  Blocks list the
   nodes of their runs with the edge before and the edge after; a third exchange
   tells which nodes branch: those that have, anywhere, more than one edge in or
   out, or at which a run begins or ends.
4. Runs are cut at branching nodes into nonbranching paths.  By construction each
   occurrence of one edge of a path lies in an occurrence of the whole path, so a
   path is one row a block, however long: its ends, its length, its least document
   in the block and a digest of the words at its source coordinates there.
5. A join brings together a path's rows of all blocks.  They are verified by the
   words at their source coordinates (SHA-256), so hashes alone remove nothing.  A
   path's words leave every document but the least that has it.

Windows are judged on the input.  Cases: null or empty texts have no words; fewer
words than a window: nothing repeats; rows with equal ids do not remove each
other's words; a row without an id neither loses words nor takes any from others;
a very long text is a block of its own; a periodic text has branching nodes, so its
paths are short; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .textarrays import Chunk, Words, chunks, mix, shingle_hashes, within, word_hashes, words

WINDOW = 13
SEED_WORDS = 5
_LINK = np.uint64(0xD1342543DE82EF95)
MINIMIZERS, EDGES, NODES = 0, 1, 2


def minimizers(h: np.ndarray) -> np.ndarray:
    """The least 5-word hash in the window from each word on."""
    s = shingle_hashes(h, SEED_WORDS)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = np.minimum(s[:-1], s[1:])  # 2, 4, 8 and 9 neighbours
    m = np.minimum(m[:-2], m[2:])
    m = np.minimum(m[:-4], m[4:])
    return mix(np.minimum(m[:-1], s[8:])[:n])  # minima are small: mixed, they fill all buckets alike


def _distinct(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them two documents have, and the number of each entry's key."""
    if not len(keys):
        return keys, np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], doc[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.flatnonzero(fresh)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return k[starts], np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts), of


def _joined(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


@dataclass
class Part:
    """The windows of a chunk that are still of interest: their first word and row."""

    chunk: Chunk
    words: Words
    hashes: np.ndarray
    pos: np.ndarray
    row: np.ndarray
    edge: np.ndarray


class Block:
    """One block's texts, narrowed pass by pass to what the replies say is repeated."""

    def __init__(self, texts: pa.Table, buckets: int):
        self.buckets = buckets
        self.texts = texts
        ids = texts["doc_id"]
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.has = ids.is_valid().to_numpy(zero_copy_only=False) if texts.num_rows else np.zeros(0, bool)
        self.parts: list[Part] = []

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers, and which of them two documents of the block have."""
        keys, docs, self._m = [], [], []
        for c in chunks(self.texts["text"]):
            w = words(c)
            h = word_hashes(c, w)
            m = minimizers(h)
            row = np.repeat(np.arange(c.n_docs), np.diff(w.docs))[: len(m)] + c.first
            pos = np.flatnonzero(within(w.docs, WINDOW, len(m)) & self.has[row]) if len(m) else np.zeros(0, np.int64)
            m, row = m[pos], row[pos]
            change = np.ones(len(m), bool)
            change[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(change)
            keys.append(m[at])
            docs.append(self.ids[row[at]])
            self.parts.append(Part(c, w, h, pos, row, np.zeros(0, np.uint64)))
            self._m.append((at, len(m)))
        self.minimizer_keys, own, self._of = _distinct(_joined(keys, np.uint64), _joined(docs, np.int64))
        return self.minimizer_keys, own

    def edges(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct edges with a minimizer of two documents, and which of them two documents of the block have."""
        keys, own = self.minimizers()
        kept = (own | blocks.replies_of(replies, MINIMIZERS, keys, self.buckets, "bit"))[self._of]
        used = 0
        for p, (at, n) in zip(self.parts, self._m, strict=True):
            keep = np.repeat(kept[used : used + len(at)], np.diff(np.append(at, n)))
            used += len(at)
            p.pos, p.row = p.pos[keep], p.row[keep]
            x = p.hashes[p.pos]
            for j in range(1, WINDOW):
                x *= _LINK
                x += p.hashes[p.pos + j]
            p.edge = mix(x)
        self.edge_keys, own, self._of = _distinct(_joined([p.edge for p in self.parts], np.uint64), self.ids[_joined([p.row for p in self.parts], np.int64)])
        return self.edge_keys, own

    def nodes(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct nodes of repeated edges; of each the pair of edges around it, 0 where it is not always the same or lacks one."""
        keys, own = self.edges(replies)
        kept = (own | blocks.replies_of(replies, EDGES, keys, self.buckets, "bit"))[self._of]
        node, tag, used = [], [], 0
        for p in self.parts:
            keep = kept[used : used + len(p.pos)]
            used += len(p.pos)
            p.pos, p.row, p.edge = p.pos[keep], p.row[keep], p.edge[keep]
            follows = np.zeros(len(p.pos), bool)
            follows[1:] = (p.pos[1:] == p.pos[:-1] + 1) & (p.row[1:] == p.row[:-1])
            between = np.zeros(len(p.pos), np.uint64)
            between[1:] = mix(p.edge[:-1] * _LINK + p.edge[1:]) | np.uint64(1)
            between[~follows] = 0
            ends = np.flatnonzero(~np.append(follows[1:], False)) if len(follows) else np.zeros(0, np.int64)
            h = shingle_hashes(p.hashes, WINDOW - 1)
            node += [h[p.pos], h[p.pos[ends] + 1]] if len(h) else []
            tag += [between, np.zeros(len(ends), np.uint64)] if len(h) else []
        flat, tags = _joined(node, np.uint64), _joined(tag, np.uint64)
        order = np.argsort(flat, kind="stable")
        k, t = flat[order], tags[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.node_keys = k[starts]
        if not len(k):
            return self.node_keys, t
        least, most = np.minimum.reduceat(t, starts), np.maximum.reduceat(t, starts)
        return self.node_keys, np.where(least == most, least, np.uint64(0))

    def paths(self, replies: pa.Table) -> np.ndarray:
        """Nonbranching paths in source order: (part, first window's place, edges, first edge, last edge, row) of each."""
        self.nodes(replies)
        plain = blocks.replies_of(replies, NODES, self.node_keys, self.buckets, "bit")
        out = []
        for i, p in enumerate(self.parts):
            if not len(p.pos):
                continue
            through = plain[np.searchsorted(self.node_keys, shingle_hashes(p.hashes, WINDOW - 1)[p.pos])]
            through[0] = False
            through[1:] &= (p.pos[1:] == p.pos[:-1] + 1) & (p.row[1:] == p.row[:-1])
            at = np.flatnonzero(~through)
            n = np.diff(np.append(at, len(p.pos)))
            made = np.zeros(len(at), PATH)
            made["part"], made["at"], made["n"] = i, at, n
            made["first"], made["last"], made["row"] = p.edge[at], p.edge[at + n - 1], p.row[at]
            out.append(made)
        return np.concatenate(out) if out else np.zeros(0, PATH)

    def span(self, path: np.void) -> tuple[int, int]:
        """A path's source coordinates: its first word in its chunk, and its words."""
        return int(self.parts[path["part"]].pos[path["at"]]), int(path["n"]) + WINDOW - 1


PATH = np.dtype([("part", "i4"), ("at", "i8"), ("n", "i8"), ("first", "u8"), ("last", "u8"), ("row", "i8")])
PATHS = "first long, last long, n long, digest binary, block long, doc long"
SPANS = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,words:long>>"


def _classes(b: Block, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each distinct path with its least document, number of each entry's path)."""
    doc = b.ids[paths["row"]]
    order = np.lexsort((doc, paths["n"], paths["last"], paths["first"]))
    p = paths[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p["first"][1:] != p["first"][:-1]) | (p["last"][1:] != p["last"][:-1]) | (p["n"][1:] != p["n"][:-1])
    of = np.empty(len(p), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return order[fresh], of


def _clean(c: Chunk, w: Words, removed: np.ndarray, i: int) -> tuple[int, int, str, list[dict]]:
    a, b = int(w.docs[i]), int(w.docs[i + 1])
    gone = removed[a:b]
    if not gone.any():
        text = c.data[int(w.start[a]) : int(w.end[b - 1])].tobytes() if b > a else b""
        return b - a, 0, b" ".join(text.split()).decode(), []
    step = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    spans = [{"first": x, "words": y} for x, y in zip(first.tolist(), (last - first).tolist(), strict=True)]
    left = np.concatenate([[a], a + last]), np.concatenate([a + first, [b]])
    pieces = [b" ".join(c.data[int(w.start[x]) : int(w.end[y - 1])].tobytes().split()) for x, y in zip(*(z.tolist() for z in left), strict=True) if y > x]
    return b - a, int(gone.sum()), b" ".join(pieces).decode(), spans


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of every row.

    One exchange of the packed texts, reused by five passes; one of minimizers, about a sixth
    of the words; one of edges and one of nodes, the repeated part of the corpus alone; and a
    join of paths, a row for each path and block.
    """
    n = blocks.buckets_for(blocks.text_bytes(df, text_col))
    texts = blocks.packed(df, id_col, text_col)

    def told(kind: int):
        def listing(table: pa.Table, replies: pa.Table | None = None) -> pa.Table:
            out = []
            for number, t in blocks.unpacked(table):
                b = Block(t, n)
                if kind == MINIMIZERS:
                    keys, _ = b.minimizers()
                    out.append(blocks.asked(kind, number, keys, None, n))
                else:
                    keys, given = b.edges(replies) if kind == EDGES else b.nodes(replies)
                    out.append(blocks.asked(kind, number, keys, given.view(np.uint8) if kind == EDGES else given, n))
            return pa.concat_tables(out or [blocks.asked(kind, 0, np.zeros(0, np.uint64), None, n)])

        return listing if kind else lambda table: listing(table)

    def find_paths(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for number, t in blocks.unpacked(table):
            b = Block(t, n)
            paths = b.paths(replies)
            for i in _classes(b, paths)[0].tolist():
                path = paths[i]
                first, length = b.span(path)
                p = b.parts[path["part"]]
                text = p.chunk.data[int(p.words.start[first]) : int(p.words.end[first + length - 1])].tobytes()
                rows.append((path["first"].view(np.int64), path["last"].view(np.int64), path["n"], hashlib.sha256(b" ".join(text.split())).digest(), number, b.ids[path["row"]]))
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 2
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in PATHS.split(", ")])

    def clean(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for _, t in blocks.unpacked(table):
            b = Block(t, n)
            paths = b.paths(replies)
            entry, of = _classes(b, paths)
            least = b.ids[paths["row"][entry]]
            shorter = replies.filter(pa.compute.is_valid(replies["least"]))
            earlier = {(x, y, z): d for x, y, z, d in zip(*(shorter[c].to_pylist() for c in ("first", "last", "n", "least")), strict=True)}
            if earlier:
                e = paths[entry]
                least = np.array([min(d, earlier.get(k, d)) for d, k in zip(least.tolist(), zip(e["first"].view(np.int64).tolist(), e["last"].view(np.int64).tolist(), e["n"].tolist(), strict=True), strict=True)], np.int64)
            drop = b.ids[paths["row"]] > least[of] if len(paths) else np.zeros(0, bool)
            doc = t["doc_id"].to_pylist()
            for i, p in enumerate(b.parts):
                mine = paths[(paths["part"] == i) & drop]
                cover = np.zeros(p.words.n + 1, np.int32)  # neighbouring paths share words
                np.add.at(cover, p.pos[mine["at"]], 1)
                np.add.at(cover, p.pos[mine["at"]] + mine["n"] + WINDOW - 1, -1)
                removed = np.cumsum(cover)[:-1] > 0
                rows += [(doc[p.chunk.first + j], *_clean(p.chunk, p.words, removed, j)) for j in range(p.chunk.n_docs)]
        return rows_table(rows)

    def cogrouped(replies: DataFrame, f, schema: str) -> DataFrame:
        return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(f, schema)

    def merged(asked: DataFrame, answer, given: str | None) -> DataFrame:
        return asked.groupBy("bucket").applyInArrow(lambda t: blocks.merge(t, answer, given), blocks.REPLIED)

    replies = merged(texts.groupBy("block").applyInArrow(told(MINIMIZERS), blocks.ASKED), lambda g, _: _counts(g) > 1, None)
    replies = replies.unionByName(merged(cogrouped(replies, told(EDGES), blocks.ASKED), lambda g, own: (_counts(g) > 1) | (np.bincount(g, weights=own) > 0), "u1"))
    replies = replies.unionByName(merged(cogrouped(replies, told(NODES), blocks.ASKED), _plain, "<u8"))
    key = ["first", "last", "n", "digest"]
    # dealt once for the aggregate and the join: both read the same columns, and the last filter
    # (never null) gives the optimizer no reason to filter one side alone
    paths = cogrouped(replies, find_paths, PATHS).repartition(*key)
    source = paths.groupBy(*key).agg(F.min("doc").alias("least"), F.count("block").alias("blocks")).filter("blocks > 1").drop("blocks")
    earlier = paths.join(source, key).filter(F.coalesce(F.col("least") < F.col("doc"), F.lit(False))).select("block", "first", "last", "n", "least")
    return cogrouped(replies.unionByName(earlier, allowMissingColumns=True), clean, SPANS)


def _counts(group: np.ndarray) -> np.ndarray:
    return np.bincount(group)


def _plain(group: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Nodes with one edge in and one out, the same everywhere."""
    if not len(group):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(tag, starts)
    return (least == np.maximum.reduceat(tag, starts)) & (least > 0)


def rows_table(rows: list[tuple]) -> pa.Table:
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
    names = ["doc_id", "n_words", "n_removed", "kept", "spans"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
