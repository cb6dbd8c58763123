"""Personal data: base patterns and bootstrapped contextual extraction (operator 3).

Base patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
telephone numbers in whole texts.  They are the seeds: the two words before a
find are a lexical pattern.  Every other token with a digit or an ``@``, of four
characters or more without its outer punctuation, is an instance that patterns may
claim; digit groups with single spaces between them are one instance.  Spark scores the graph of patterns and
instances for ``ROUNDS`` rounds: a pattern is as sure of a kind as the share of
its distinct instances that are of it, an instance as sure as the noisy-or of its
patterns.  Patterns with at least ``SUPPORT`` instances' worth of evidence and
confidence ``SURE`` then claim unseen identifiers, which are added to the base.

Words and identifiers may be of any length; those over ``KEPT`` characters are told
apart by a 128-bit hash.

Cases: a null text is an empty one; a very long text or line is read whole, in time
linear in its length; no finds give an empty string; a find that
fails its test is dropped and not tried again; identical rows are each reported;
equal scores go to the kind listed first; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5
SURE = 0.8
KEPT = 128

# The possessive forms and the look-behind find what the plain patterns find, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINT = re.compile(r"[0-9@]")
_HINTS = re.compile(r"[0-9@]+")
_SPACES = re.compile(r"[\x20\x09-\x0d]")
_GROUPS = re.compile(r"[0-9(+][0-9().+-]*+(?:\x20[0-9(][0-9().-]*+)+[,;:!?]*+(?=[\x20\x09-\x0d]|\Z)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost finds: the run of name characters left of each ``@``, not reaching into the find before."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, start)
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, end exclusive, in code points."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not _HINT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def key(text: str) -> str:
    """A text in lower case, or its hash if it is long."""
    out = text.lower()
    return out if len(out) <= KEPT else "#" + hashlib.blake2b(out.encode(), digest_size=16).hexdigest()


def patterns_before(text: str, starts: list[int]) -> Iterator[str]:
    """For each of the ascending places the two words before it, lower-cased; a line start counts as a word."""
    line = at = 0
    for start in starts:
        newline = text.rfind("\n", at, start)
        line, at = (newline + 1 if newline >= 0 else line), start
        reach = KEPT
        while True:  # as far back as two whole words need
            low = max(line, start - reach)
            words = text[low:start].split()
            if low == line or len(words) > 2:
                break
            reach *= 2
        yield key(" ".join(["^", "^", *words][-2:]))


def instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @ that no base find touches, without outer punctuation."""
    done = k = 0
    for m in _HINTS.finditer(text):
        if m.start() < done:
            continue
        left = max(text.rfind(c, done, m.start()) for c in " \n\t\r\x0b\x0c") + 1 or done
        stop = _GROUPS.match(text, left)
        if stop is None:
            stop = _SPACES.search(text, m.end())
            right = stop.start() if stop else len(text)
        else:
            right = stop.end()
        done = right
        while k < len(base) and base[k][2] <= left and base[k][0] < left:
            k += 1
        if any(s < right and e > left for s, _, e in base[k : k + 8]):
            continue
        token = text[left:right]
        inner = token.strip(".,;:!?\"'()[]{}<>|*#$%&=")
        if len(inner) >= 4:
            left += token.index(inner)
            yield left, left + len(inner)


FOUND = "doc_id long, base array<struct<start:int,kind:int,end:int>>, edges array<struct<pattern:string,instance:string,kind:int,start:int,end:int>>"


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, edges) of every row: base finds, and pattern-instance edges (kind -1: not a seed). No shuffle."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    edge = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, edges = [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spots = [(s, e, k) for s, k, e in base]
                if _HINT.search(text):
                    spots = sorted(spots + [(s, e, -1) for s, e in instances(text, base)])
                own = [(before, key(text[s:e]), k, s, e) for (s, e, k), before in zip(spots, patterns_before(text, [s for s, *_ in spots]), strict=True)]
                bases.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in base])
                edges.append([dict(zip(("pattern", "instance", "kind", "start", "end"), x, strict=True)) for x in own])
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(bases, span), pa.array(edges, edge)], names=["doc_id", "base", "edges"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, FOUND)


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((pattern, kind, confidence), (instance, kind, confidence)): both sides of the graph after the rounds.

    edges: (pattern, instance, kind), a row for each occurrence.  Occurrences are aggregated
    before any join, so a frequent pattern is as wide as its distinct instances.
    """
    graph = written(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pattern-graph")
    width = graph.groupBy("pattern").agg(F.count("*").alias("width"))
    seeds = graph.filter("kind >= 0").select("instance", "kind").distinct().withColumn("confidence", F.lit(1.0))
    sure = seeds
    patterns = None
    for _ in range(rounds):
        support = graph.select("pattern", "instance").join(sure, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("support"))
        scored = support.filter(F.col("support") >= SUPPORT).join(width, "pattern").withColumn("confidence", F.col("support") / (F.col("width") + 1))
        patterns = scored.filter(F.col("confidence") >= SURE).select("pattern", "kind", "confidence")
        claimed = graph.filter("kind < 0").select("pattern", "instance").join(patterns, "pattern").groupBy("instance", "kind")
        new = claimed.agg((1 - F.exp(F.sum(F.log(1 - 0.9 * F.col("confidence"))))).alias("confidence"))
        sure = seeds.unionByName(new).groupBy("instance", "kind").agg(F.max("confidence").alias("confidence"))
    return patterns, sure


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, spans): base finds, and all finds, as arrays of (start, kind, end) in order."""
    found = written(extract(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii")
    edges = found.select("row", F.explode("edges").alias("e")).select("row", "e.*")
    patterns, _ = score_patterns(edges.select("pattern", "instance", "kind"))
    open_ = edges.filter("kind < 0").drop("kind").join(patterns, "pattern")
    best = open_.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("x"))
    extra = best.groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("x.k")).alias("kind"), "end")).alias("extra"))
    all_ = F.array_sort(F.concat("base", F.coalesce("extra", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))))
    return found.select("row", "doc_id", "base").join(extra, "row", "left").select("row", "doc_id", "base", all_.alias("spans"))


def shown(spans: str) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def count_of(spans: str, kind: int) -> F.Column:
    """How many of the spans are of the kind (an index into KINDS)."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every find replaced by its kind in brackets; n_chars, if there, follows the new text.

    Patterns are few, aggregated and above a support, but not bounded, so finds
    beyond the base come back by a join on the row.
    """
    keyed = written(df.withColumn("_row", F.monotonically_increasing_id()), "redact")
    spans = find(keyed.select(F.col("_row").alias("doc_id"), text_col), "doc_id", text_col).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_row"), F.col("spans").alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = []
            for text, finds in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index("_spans")).to_pylist(), strict=True):
                out.append(text if not finds else blanked(text, [(x["start"], x["kind"], x["end"]) for x in finds]))
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.record_batch(cols, schema=pa.schema([b.schema.field(i) if i != at else pa.field(text_col, pa.string()) for i in range(b.num_columns)]))

    joined = keyed.join(spans, "_row", "left")
    clean = joined.mapInArrow(run, joined.schema).drop("_row", "_spans")
    if "n_chars" in df.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_col).cast(df.schema["n_chars"].dataType)))
    return clean.select(*df.columns)


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping finds blank their union, under the name of the first."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
