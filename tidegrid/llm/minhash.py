"""Near-duplicates by an inverted join over signature coordinates (operator 6).

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), a key
   of that set and ``COORDINATES`` minima.  Texts with equal sets form a class;
   only its least document goes on.
2. A signature is a record of (coordinate, value) tokens.  Two records that agree
   in ``MATCHES`` of n tokens share one of their n - MATCHES + 1 rarest tokens
   (prefix filter under one global order, rarest first), so only those are
   posted.  Tokens that no other class has are skipped before anything is joined.
3. Posting lists are joined in two rounds.  First every class meets the hub of
   each of its lists, the member whose tokens are the most common (a star: linear
   in the list).  After a component pass, lists whose members still lie in several
   components pair the members outside the list's largest component with all
   members of other components.  Pairs inside one component need no further test.
   Before that, members that nobody can be linked with are skipped: a linked class
   shares 85 % of its shingles, so one of which more occur in no other such member
   has no link (counted on full sets: an exact bound).
   Of the others a pair is kept if its sizes, the shingles that only one of the
   lists' members has, and those that either lacks of a common hub leave room for
   the similarity (exact bounds).  So a group of thousands of near copies is not
   expanded into its pairs.  Lists longer than ``CELL`` are cut into parts, and each
   pair of parts is a join key of its own, so no list is one task.
4. Candidates with ``CLOSE`` of ``COORDINATES`` equal coordinates and fitting sizes
   are confirmed on the full shingle sets, 100 * intersection >= 85 * union.

Only the first ``POSTED`` coordinates are posted.  At similarity 0.85 a pair has
fewer than 7 of 16 equal coordinates with probability 2e-5 and fewer than 40 of 64
with 3e-6 (binomial).  There is no other way to miss a link.

Cases: null or empty texts have no shingles and no links; fewer words than a
shingle count as one; equal texts are one class; rows with equal ids are one
node; a row without an id is never linked; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import written
from .textarrays import chunks, mix, sequence_hash, shingle_hashes, word_hashes, words

WORDS = 5
COORDINATES = 64
CLOSE = 40
POSTED = 16
MATCHES = 7
CELL = 256
PERCENT = 85
_SEEDS = np.random.default_rng(3).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, n_shingles long, set_key binary, signature array<int>"


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column, A-Z lower-cased."""
    for c in chunks(column, lower=True):
        w = words(c)
        h = word_hashes(c, w)
        s = shingle_hashes(h, k)
        for i in range(c.n_docs):
            a, b = int(w.docs[i]), int(w.docs[i + 1])
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield np.array([sequence_hash(h[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The high halves of the minima of s under each multiplier, as 32-bit integers."""
    low = (s * _SEEDS[:, None]).min(axis=1) if len(s) < 4096 else np.array([(s * x).min() for x in _SEEDS])
    return (mix(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of every row; no key where there are no shingles. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, keys, sigs = [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "set_key", "signature"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, SIGNED)


def postings(classes: DataFrame) -> DataFrame:
    """(coord, value, node, n, central): the rarest tokens of each class that other classes have too."""
    tokens = classes.select("node", "n", F.posexplode(F.slice("signature", 1, POSTED)).alias("coord", "value"))
    # written, as the other tables by list: a join of two scans can split a long list, one with an aggregate cannot
    shared = written(tokens.groupBy("coord", "value").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    rows = tokens.join(shared, ["coord", "value"]).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "coord", "value"))).alias("t"))
    # tokens of one class alone come first in the order: they use up the prefix without a posting
    keep = F.size("t") - F.lit(MATCHES - 1)
    central = F.aggregate("t", F.lit(0.0), lambda s, x: s + F.log2(x["df"].cast("double")))
    posted = rows.filter(keep > 0).select("node", "n", central.alias("central"), F.explode(F.expr(f"slice(t, 1, size(t) - {MATCHES - 1})")).alias("x"))
    return posted.select(F.col("x.coord").alias("coord"), F.col("x.value").alias("value"), "node", "n", "central")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, h): the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(shingle_sets(b.column(1)) if b.num_rows else ()):
                yield pa.record_batch([pa.array(np.full(len(s), b.column(0)[i].as_py(), np.int64)), pa.array(s.view(np.int64))], names=["node", "h"])

    return texts.select("node", "text").mapInArrow(run, "node long, h long")


def linkable(texts: DataFrame, of: DataFrame) -> DataFrame:
    """The nodes (node, n) of ``of`` whose shingles occur in others of them often enough for any link."""
    near = texts.join(of.select("node").hint("merge"), "node", "left_semi")
    alone = shingle_rows(near).groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("df")).filter("df = 1").groupBy("node").agg(F.count("*").alias("own"))
    return of.join(alone, "node", "left").filter(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= PERCENT * F.col("n")).select("node")


def traits(texts: DataFrame, pivots: DataFrame) -> DataFrame:
    """(node, own, pivot, lacks): how many shingles no other of these nodes has, and those of the pivot that the node lacks.

    pivots: (node, pivot).  A pivot that is far from the node gives no list.
    """
    wanted = pivots.select("node").unionByName(pivots.select(F.col("pivot").alias("node"))).distinct()
    near = written(texts.join(wanted, "node", "left_semi"), "near-texts")
    # a pivot counts too, so that no shingle of a pivot is any other node's own
    alone = shingle_rows(near).groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("df")).filter("df = 1").groupBy("node").agg(F.count("*").alias("own"))
    pivot_text = near.select(F.col("node").alias("pivot"), F.col("text").alias("pt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            lacks = []
            for i, s in enumerate(shingle_sets(b.column(2)) if b.num_rows else ()):
                key = b.column(1)[i].as_py()
                if key not in held:
                    if len(held) > 64:
                        held.clear()
                    held[key] = next(shingle_sets(b.column(3).slice(i, 1)))
                gone = np.setdiff1d(held[key], s, assume_unique=True)
                lacks.append(gone.view(np.int64) if 4 * len(gone) <= len(held[key]) else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lacks, pa.list_(pa.int64()))], names=["node", "pivot", "lacks"])

    both = pivots.join(near, "node").join(pivot_text, "pivot").select("node", "pivot", "text", "pt")
    lists = both.mapInArrow(run, "node long, pivot long, lacks array<long>")
    return lists.join(alone, "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"), "pivot", "lacks")


def _fits(a: str, b: str) -> F.Column:
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _may_link(x: str, y: str) -> F.Column:
    """Whether two sets may reach the similarity, from sizes, own shingles and what they lack of a common pivot.

    Common shingles are at most those of either side that are not its own; of these,
    pivot shingles that only the other side lacks are not common either.  The pivot's
    own shingles are what others lack of it, so they count once.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    enough = lambda c: (100 + PERCENT) * c >= PERCENT * (col(x, "n") + col(y, "n"))

    def most(a: str, b: str) -> F.Column:
        own = F.when(col(a, "node") == col(a, "pivot"), 0).otherwise(col(a, "own"))
        return col(a, "n") - own - F.size(F.array_except(col(b, "lacks"), col(a, "lacks")))

    plain = F.least(col(x, "n") - col(x, "own"), col(y, "n") - col(y, "own"))
    comparable = (col(x, "pivot") == col(y, "pivot")) & col(x, "lacks").isNotNull() & col(y, "lacks").isNotNull()
    return enough(plain) & (~comparable | enough(F.least(most(x, y), most(y, x))))


def _mixed(member: DataFrame) -> DataFrame:
    """Members of the lists that span components, with the list's largest component (major)."""
    sizes = member.groupBy("coord", "value", "component").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("coord", "value").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    return member.join(written(mixed.select("coord", "value", F.col("top.component").alias("major")), "mixed"), ["coord", "value"])


def _cells(of_mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of each list: its members dealt to parts, each part once for every part of the other side."""
    sizes = written(of_mixed.groupBy("coord", "value").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")), "sizes")
    dealt = of_mixed.join(sizes, ["coord", "value"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.filter("component <> major").withColumn("other", other)
    right = dealt.withColumnRenamed("part", "mine").withColumn("part", other).withColumnRenamed("mine", "other")
    return left, right


CONFIRMED = "a long, b long"


def confirm(pairs: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) those with enough equal coordinates and, on their full sets, the similarity."""
    sa = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    sb = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = pairs.join(sa, "a").join(sb, "b").filter(equal >= CLOSE).select("a", "b")
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(batch.num_rows, bool)
            held: dict[int, np.ndarray] = {}
            left = shingle_sets(batch.column(2))
            for i, (x, y) in enumerate(zip(left, batch.column(3), strict=True)):
                key = b[i].as_py()
                if key not in held:
                    if len(held) > 64:
                        held.clear()
                    held[key] = next(shingle_sets(pa.array([y.as_py()], pa.string())))
                z = held[key]
                both = len(np.intersect1d(x, z, assume_unique=True))
                keep[i] = 100 * both >= PERCENT * (len(x) + len(z) - both)
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(keep))

    return close.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, CONFIRMED)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(signed(docs), "signatures")
    named = sets.filter("set_key is not null and doc_id is not null")
    classes = written(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")
    posts = written(postings(classes), "postings")

    # texts of the classes that have a posting at all; these grow with the input, so they are never sent to all
    active = posts.select("node").distinct()
    texts = written(docs.join(active.hint("merge"), docs.doc_id == active.node, "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
    signatures = classes.select("node", "signature")

    hubs = written(posts.groupBy("coord", "value").agg(F.max(F.struct("central", (-F.col("node")).alias("i"), "node", "n")).alias("hub"), F.count("*").alias("k")).filter("k > 1"), "hubs")
    star = posts.join(hubs, ["coord", "value"]).select(F.col("node").alias("a"), "n", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"))
    star = star.filter((F.col("a") != F.col("b")) & _fits("n", "m")).select("a", "b").distinct()
    links = written(confirm(star, signatures, texts), "star-links")
    found = components(links)

    member = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("central")
    member = written(member, "members")
    hopeful = written(linkable(texts, written(_mixed(member).select("node", "n").distinct(), "spanning")), "linkable")
    of_mixed = written(_mixed(member.join(hopeful, "node", "left_semi")), "hopeful")
    # of the hubs a node meets the most central one is its pivot: near copies mostly have the same
    pivots = of_mixed.join(hubs, ["coord", "value"]).groupBy("node").agg(F.max(F.struct("hub.central", "hub.i"))["i"].alias("i")).select("node", (-F.col("i")).alias("pivot"))
    known = written(traits(texts, written(pivots, "pivots")), "traits")
    # the traits of one node are some tens of integers; a list's members pair by what could link at all
    of_mixed = written(of_mixed.join(known, "node"), "mixed")
    left, right = (side.alias(name) for side, name in zip(_cells(of_mixed), "xy", strict=True))
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.node") > F.col("y.node")))
    same = reduce(and_, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("coord", "value", "part", "other")])
    rest = left.join(right, same & apart & _may_link("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = written(confirm(rest.distinct(), signatures, texts), "rest-links")
    if more.limit(1).count():
        found = components(links.unionByName(more))

    node = classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("class_id"))
    out = sets.join(node, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
