"""Language-model scores from a weighted backoff automaton (operator 9).

Training counts every word and every two and three neighbouring tokens of the whole
corpus; nothing is pruned.  The model is hierarchical Dirichlet smoothing: with
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
p(w | v) = (c(v, w) + K1 p(w)) / (c(v) + K1) and
p(w | u, v) = (c(u, v, w) + K2 p(w | v)) / (c(u, v) + K2); the start of a text is a
context too.

As an automaton: the root, a state for each seen word and one for each seen pair.  A
seen continuation is an arc with its log-probability; it leads to the state of the
longest seen suffix.  Every other state has a failure arc to the state of its suffix,
with weight log(K / (c + K)); the root has an arc for each token.  A traversal reads
each text once from left to right and carries its state: while the state has no arc
for the token it takes the failure arc, adding its weight, and then the arc.  Texts
are cut into pieces that are traversed side by side; since states are at most two
tokens deep, reading the two tokens before a piece from the root gives its state.

The automaton of the whole corpus never is in one place: a block of documents asks
for the counts of its own distinct words, pairs and triples and so gets the part of
the automaton that its texts can reach.  A triple is asked for only if other blocks
have both of its pairs: otherwise no other block can have it, and its own count is
the total.

Cases: a null or empty text is the end token alone; unseen words take the smoothed
zero count from the root; without training rows the model is uniform; a very long
text is a block of its own; every row is scored, equal and null ids included; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .textarrays import chunks, mix, word_hashes, words

#: Weight of the shorter context's distribution, as so many tokens, in contexts of one and two tokens.
K1, K2 = 20.0, 2.0
ADD = 0.1
START = np.uint64(0x5851F42D4C957F2D)  # the context before a text
END = np.uint64(0x14057B7EF767814F)  # the token after it
_LINK = np.uint64(0xD1342543DE82EF95)
WORDS, PAIRS, TRIPLES = 0, 1, 2
#: Tokens of a piece, beside the two before it.
PIECE = 256

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def link(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LINK + right)


@dataclass
class Keys:
    """Sorted distinct keys, the training occurrences of each, one entry of each, and the key of every entry."""

    keys: np.ndarray
    counts: np.ndarray
    entry: np.ndarray
    of: np.ndarray


def distinct(x: np.ndarray, weight: np.ndarray) -> Keys:
    order = np.argsort(x, kind="stable")
    k = x[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(fresh)
    of = np.empty(len(x), np.int32)
    of[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return Keys(k[at], np.add.reduceat(weight[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64), order[at], of)


class Block:
    """A block's texts as one array of token hashes, each text with its end."""

    def __init__(self, table: pa.Table):
        tokens, ends = [], [np.zeros(1, np.int64)]
        for c in chunks(table["text"], lower=True):
            w = words(c)
            off = np.cumsum(np.diff(w.docs) + 1)
            t = np.full(int(off[-1]), END, np.uint64)
            inner = np.ones(len(t), bool)
            inner[off - 1] = False
            t[inner] = word_hashes(c, w)
            tokens.append(t)
            ends.append(off + ends[-1][-1])
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.off = np.concatenate(ends)
        self.train = np.repeat(~table["held_out"].to_numpy(), np.diff(self.off))
        self.is_end = self.token == END

    def words(self) -> Keys:
        """Distinct words; entries are the tokens but the ends."""
        return distinct(self.token[~self.is_end], self.train[~self.is_end])

    def _pair(self) -> np.ndarray:
        left = np.empty_like(self.token)
        left[1:] = self.token[:-1]
        left[self.off[:-1]] = START
        return link(left, self.token)

    def pairs(self) -> Keys:
        """Distinct pairs; the entry of a token is its pair with the one before."""
        return distinct(self._pair(), self.train)

    def inner(self) -> np.ndarray:
        """Places at which a triple ends: all but the first of each text."""
        out = np.ones(len(self.token), bool)
        out[self.off[:-1]] = False
        return out

    def triples(self, at: np.ndarray) -> Keys:
        """Distinct triples that end at the given places; entries in their order."""
        return distinct(link(self._pair()[at - 1], self.token[at]), self.train[at])

    def shared(self, pairs: Keys, elsewhere: np.ndarray) -> np.ndarray:
        """Places of triples of which other blocks have both pairs."""
        other = elsewhere[pairs.of]
        keep = self.inner()
        keep[1:] &= other[1:] & other[:-1]
        return np.flatnonzero(keep)


class Automaton:
    """The part of the automaton that a block's texts can reach.

    State 0 is the root, then come seen words (and the start of a text), then seen pairs.
    The arcs that a token may take at each depth are found with the counts, so a step
    needs no search: ``arc2`` and ``arc1`` are those of the place, -1 where training has none.
    """

    def __init__(self, block: Block, words: Keys, pairs: Keys, triples: Keys, n: int, v: int, texts: int):
        self.off = block.off
        end, start = len(words.keys), len(words.keys) + 1
        self.number = np.full(len(block.token), end, np.int32)
        self.number[~block.is_end] = words.of
        before = np.empty_like(self.number)
        before[1:] = self.number[:-1]
        before[block.off[:-1]] = start
        count = np.append(words.counts, texts).astype(float)
        root = (count + ADD) / (n + ADD * (v + 1))
        context = np.concatenate([words.counts, [0, texts]]).astype(float)  # nothing follows an end
        has = context > 0
        word_state = np.where(has, np.cumsum(has), 0)
        self.depth1 = int(has.sum())  # the last state of one token
        left, right, pc = before[pairs.entry], self.number[pairs.entry], pairs.counts.astype(float)
        p1 = (pc + K1 * root[right]) / (context[left] + K1)
        seen = pc > 0
        pair_state = np.where(seen, self.depth1 + np.cumsum(seen), 0)
        self.count, self.root_weight, self.root_target = count, np.log10(root), np.append(word_state[:end], 0)
        self.weight1, self.target1 = np.log10(p1), np.where(right == end, 0, pair_state)
        at = np.flatnonzero(block.inner())
        of1, of2, tc = pairs.of[at[triples.entry] - 1], pairs.of[at[triples.entry]], triples.counts.astype(float)
        self.weight2, self.target2 = np.log10((tc + K2 * p1[of2]) / (pc[of1] + K2)), self.target1[of2]
        self.failure = np.concatenate([np.zeros(1 + self.depth1, np.int64), word_state[right[seen]]])
        self.failure_weight = np.concatenate([[0.0], np.log10(K1 / (context[has] + K1)), np.log10(K2 / (pc[seen] + K2))])
        self.start = int(word_state[start])
        self.arc1 = np.where(seen[pairs.of], pairs.of, -1)
        self.arc2 = np.full(len(block.token), -1, np.int32)
        self.arc2[at] = np.where((tc > 0)[triples.of], triples.of, -1)

    def step(self, state: np.ndarray, token: np.ndarray, arc1: np.ndarray, arc2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log-probabilities): failure arcs until there is an arc, then the arc."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        deep = state > self.depth1
        take = np.flatnonzero(deep & (arc2 >= 0))
        weight[take], after[take] = self.weight2[arc2[take]], self.target2[arc2[take]]
        deep[take] = False
        fall = np.flatnonzero(deep)
        weight[fall] = self.failure_weight[state[fall]]
        state = state.copy()
        state[fall] = self.failure[state[fall]]
        left = np.ones(len(state), bool)
        left[take] = False
        one = left & (state > 0)
        take = np.flatnonzero(one & (arc1 >= 0))
        weight[take] += self.weight1[arc1[take]]
        after[take] = self.target1[arc1[take]]
        left[take] = one[take] = False
        fall = np.flatnonzero(one)
        weight[fall] += self.failure_weight[state[fall]]
        rest = np.flatnonzero(left)
        weight[rest] += self.root_weight[token[rest]]
        after[rest] = self.root_target[token[rest]]
        return after, weight

    def traverse(self) -> np.ndarray:
        """The log-probability of each text: one left-to-right pass, pieces side by side."""
        off = self.off
        n = -(-np.diff(off) // PIECE)
        text = np.repeat(np.arange(len(off) - 1), n)
        first = off[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
        end = np.minimum(first + PIECE, off[text + 1])
        begin = np.where(first == off[text], first, first - 2)
        state = np.where(first == off[text], self.start, 0)
        order = np.argsort(begin - end, kind="stable")  # the longest first: those still running are a prefix
        text, first, begin, state = text[order], first[order], begin[order], state[order]
        total, length = np.zeros(len(text)), (end[order] - begin)
        for j in range(int(length[0]) if len(length) else 0):
            running = int(np.searchsorted(-length, -j, "left"))
            at = begin[:running] + j
            state[:running], w = self.step(state[:running], self.number[at], self.arc1[at], self.arc2[at])
            total[:running] += np.where(at >= first[:running], w, 0.0)
        return np.bincount(text, weights=total, minlength=len(off) - 1)


#: In replies to pairs, added to the count where other blocks have the pair.
ELSEWHERE = 1 << 62


def _totals(table: pa.Table) -> pa.Table:
    """Totals as 64-bit integers, so that one type serves any corpus (they deflate well)."""

    def answer(group: np.ndarray, given: np.ndarray | None) -> np.ndarray:
        if not len(group):
            return np.zeros(0, "<i8")
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        total = np.add.reduceat(given.astype(np.int64), starts)
        return total + np.where(np.diff(np.append(starts, len(group))) > 1, ELSEWHERE, 0)

    return blocks.merge(table, answer, "<u4")


def _sums(table: pa.Table) -> pa.Table:
    """Tokens and distinct training words of one bucket of words."""
    keys, given = blocks.lists(table, "<u4")
    k, n = np.concatenate(keys), np.concatenate(given).astype(np.int64)
    return pa.table({"n": pa.array([int(n.sum())], pa.int64()), "v": pa.array([len(np.unique(k[n > 0]))], pa.int64())})


def _told(replies: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals, which of the keys other blocks have)."""
    got = blocks.replies_of(replies, kind, keys, buckets, "<i8")
    return got & (ELSEWHERE - 1), got >= ELSEWHERE


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row by a model of the rows where held_out is false.

    One exchange of the packed texts, reused by four passes; one each of the blocks' distinct
    words, pairs and those triples that other blocks can have.
    """
    n = blocks.buckets_for(blocks.text_bytes(df, text_col))
    texts = blocks.packed(df, id_col, text_col, {"held_out": F.coalesce(held_out, F.lit(False))})

    def listed(kind: int):
        def run(table: pa.Table) -> pa.Table:
            out = []
            for number, t in blocks.unpacked(table):
                k = Block(t).words() if kind == WORDS else Block(t).pairs()
                out.append(blocks.asked(kind, number, k.keys, k.counts.astype("<u4"), n))
            return pa.concat_tables(out)

        return run

    def list_triples(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for number, t in blocks.unpacked(table):
            b = Block(t)
            pairs = b.pairs()
            k = b.triples(b.shared(pairs, _told(replies, PAIRS, pairs.keys, n)[1]))
            out.append(blocks.asked(TRIPLES, number, k.keys, k.counts.astype("<u4"), n))
        return pa.concat_tables(out or [blocks.asked(TRIPLES, 0, np.zeros(0, np.uint64), None, n)])

    def walk(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        tokens, distinct_, trained = (int(replies[k][0].as_py() or 0) if replies.num_rows else 0 for k in ("tokens", "distinct", "docs"))
        for _, t in blocks.unpacked(table):
            b = Block(t)
            words_, pairs, triples = b.words(), b.pairs(), b.triples(np.flatnonzero(b.inner()))
            words_.counts = _told(replies, WORDS, words_.keys, n)[0]
            pairs.counts, elsewhere = _told(replies, PAIRS, pairs.keys, n)
            wide = b.triples(b.shared(pairs, elsewhere)).keys
            triples.counts[np.searchsorted(triples.keys, wide)] = _told(replies, TRIPLES, wide, n)[0]
            automaton = Automaton(b, words_, pairs, triples, tokens + trained, distinct_ + (trained > 0), trained)
            if t.num_rows:
                begin = b.off[:-1]
                base = np.add.reduceat(automaton.root_weight[automaton.number], begin)
                known = np.add.reduceat((automaton.count > 0)[automaton.number].astype(np.int64), begin)
                rows += zip(t["doc_id"].to_pylist(), t["held_out"].to_pylist(), np.diff(b.off).tolist(), known.tolist(), [tokens + trained] * t.num_rows, base.tolist(), automaton.traverse().tolist(), strict=True)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in SCORED.split(", ")])

    def merged(asked: DataFrame) -> DataFrame:
        return asked.groupBy("bucket").applyInArrow(_totals, blocks.REPLIED)

    def cogrouped(replies: DataFrame, f, schema: str) -> DataFrame:
        return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(f, schema)

    word_lists = texts.groupBy("block").applyInArrow(listed(WORDS), blocks.ASKED)
    pairs = merged(texts.groupBy("block").applyInArrow(listed(PAIRS), blocks.ASKED))
    triples = merged(cogrouped(pairs, list_triples, blocks.ASKED))
    sums = word_lists.groupBy("bucket").applyInArrow(_sums, "n long, v long").agg(F.sum("n").alias("tokens"), F.sum("v").alias("distinct"))
    docs = df.select((~F.coalesce(held_out, F.lit(False))).alias("t")).agg(F.count_if("t").alias("docs"))
    replies = merged(word_lists).unionByName(pairs).unionByName(triples)
    # N, V and the number of training texts, as values of scalar subqueries
    replies = replies.select("*", sums.select(F.struct("tokens", "distinct")).scalar().alias("sums"), docs.scalar().alias("docs")).select("*", "sums.*").drop("sums")
    return cogrouped(replies, walk, SCORED)
