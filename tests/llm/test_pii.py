from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import pii, queries

from .conftest import SMALL

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) * 2 // 10 for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text: str | None):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"ab@..@+-%_ 1205() é\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 567-8901", "255.256.1.1"]), max_size=30).map("".join))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


RUNS = ("a", "1", "1.", "a@", "a@b-", "1 ", "+1(", "x9 ", "9\n")


@pytest.mark.parametrize("run", RUNS)
def test_long_runs_take_linear_time(run):
    def took(n):
        text, began = run * n, time.perf_counter()
        base = pii.base_spans(text)
        spots = list(pii.instances(text, base))
        sum(1 for _ in pii.patterns_before(text, [s for s, _ in spots]))
        return time.perf_counter() - began

    assert pii.base_spans(run * 200) == brute(run * 200)
    assert took(400_000) < 12 * took(100_000) + 0.5


PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&="


def edges_of(text):
    """(pattern, instance, kind, start, end) by plain splitting."""
    text = text or ""
    base = brute(text)
    spots = [(s, e, k) for s, k, e in base]
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
    i = 0
    while i < len(tokens):
        left, right = tokens[i]
        i += 1
        if not re.search("[0-9@]", text[left:right]):
            continue
        if re.fullmatch(r"[0-9(+][0-9().+-]*", text[left:right]):
            while i < len(tokens) and tokens[i][0] == right + 1 and text[right] == " ":
                more = re.fullmatch(r"[0-9(][0-9().-]*([,;:!?]*)", text[slice(*tokens[i])])
                if not more:
                    break
                right = tokens[i][1]
                i += 1
                if more[1]:
                    break
        inner = text[left:right].strip(PUNCTUATION)
        if len(inner) >= 4 and not any(s < right and e > left for s, _, e in base):
            left += text[left:right].index(inner)
            spots.append((left, left + len(inner), -1))
    out = []
    for s, e, k in sorted(spots):
        line = text[:s].rpartition("\n")[2]
        out.append((" ".join(["^", "^", *line.lower().split()][-2:]), text[s:e].lower(), k, s, e))
    return out


def spans_of(texts):
    """All spans of each text, the graph scored with dictionaries."""
    edges = [edges_of(t) for t in texts]
    graph = {}
    for p, i, k, *_ in (e for doc in edges for e in doc):
        graph[p, i] = max(graph.get((p, i), -1), k)
    seeds = {(i, k): 1.0 for (_, i), k in graph.items() if k >= 0}
    sure, patterns = dict(seeds), {}
    for _ in range(pii.ROUNDS):
        patterns = {}
        for p in {p for p, _ in graph}:
            own = [i for q, i in graph if q == p]
            for k in range(4):
                support = sum(sure.get((i, k), 0.0) for i in own)
                if support >= pii.SUPPORT and support / (len(own) + 1) >= pii.SURE:
                    patterns[p, k] = support / (len(own) + 1)
        sure = dict(seeds)
        for i in {i for (_, i), k in graph.items() if k < 0}:
            for k in range(4):
                by = [patterns[p, k] for (p, j), was in graph.items() if j == i and was < 0 and (p, k) in patterns]
                if by:
                    sure[i, k] = max(sure.get((i, k), 0.0), 1 - math.prod(1 - 0.9 * c for c in by))
    out = []
    for text, doc in zip(texts, edges, strict=True):
        spans = brute(text)
        for p, _, was, s, e in doc:
            best = max(((patterns[p, k], -k) for k in range(4) if (p, k) in patterns), default=None)
            if was < 0 and best:
                spans.append((s, -best[1], e))
        out.append(sorted(spans))
    return out


def found(df):
    return {r.doc_id: [(s["start"], s["kind"], s["end"]) for s in r.spans] for r in pii.find(df).collect()}


def test_discovery_against_brute_force(frame):
    r, texts = random.Random(9), []
    for i in range(120):
        # most are of the kind, so that the contexts are sure enough
        mail = f"user{i}@mail.example.org" if r.random() < 0.9 else r.choice((f"user{i}@mail.example.org", f"user{i}-at-mail", f"u{i % 30}@x.org,", "nobody"))
        call = f"+49 30 {i:07}" if r.random() < 0.9 else r.choice((f"+49 30 {i:07}", f"555 12{i % 10} {i:04}", f"({i:03}) 555 {i:04}!", "later"))
        texts.append(f"{r.choice(('Please', 'do'))} write to {mail} soon\nor call me: {call} and version {i}.{i} of\tfile{i}.txt " + ("x" * 300 + str(i)) * (i % 7 == 0))
    texts += [None, "", "write to " + "user-at-" + "z9" * 50_000, "no line " * 30_000 + "call me: 555 999 1234", "w " * 400 + "q" * 5000 + " write to a1b2c3 end"]
    want = dict(enumerate(spans_of(texts)))
    assert found(frame(list(enumerate(texts)))) == want
    assert sum(len(v) for v in want.values()) > sum(len(brute(t)) for t in texts) + 5
    assert len(want[122]) == 1 and want[122][0][2] == 9 + 8 + 100_000


def test_query_adds_what_brute_force_adds(spark, documents):
    rows = {r.doc_id: r.spans for r in queries.op3_pii(spark, SMALL).collect()}
    for d, spans in zip(documents, spans_of([d["text"] for d in documents]), strict=True):
        assert rows[d["doc_id"]] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_query_has_the_base_finds(spark, documents):
    rows = {r.doc_id: r for r in queries.op3_pii(spark, SMALL).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        want, r = brute(d["text"]), rows[d["doc_id"]]
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r.spans.split(",")) | {""}


def test_patterns_discover_unseen_identifiers(frame):
    rows = [(i, f"text before. contact me at user{i}@mail.example.org today") for i in range(20)]
    rows += [(100, "please contact me at user7-at-mail today"), (101, "version abc-123 of it"), (102, None), (103, "")]
    out = {r.doc_id: [(s["start"], s["kind"], s["end"]) for s in r.spans] for r in pii.find(frame(rows)).collect()}
    assert out[100] == [(21, 0, 34)]
    assert out[101] == out[102] == out[103] == []
    assert out[3] == brute(rows[3][1])


def test_redaction(frame):
    rows = [(1, "mail a@b.co or 10.0.0.1."), (1, "mail a@b.co or 10.0.0.1."), (2, None), (3, "clean"), (None, "+49 30 1234567 é")]
    out = sorted(((r.doc_id, r.text) for r in pii.redact(frame(rows)).collect()), key=repr)
    assert out == sorted([(1, "mail [EMAIL] or [IP]."), (1, "mail [EMAIL] or [IP]."), (2, None), (3, "clean"), (None, "[PHONE] é")], key=repr)
    assert pii.redact(frame([])).count() == 0 and pii.find(frame([])).count() == 0
    clash = frame(rows).selectExpr("doc_id", "text", "1 as spans", "2 as base", "3 as edges")
    assert pii.redact(clash).columns == clash.columns
    assert pii.blanked("abcdef", [(1, 0, 4), (2, 1, 5)]) == "a[EMAIL]f"
