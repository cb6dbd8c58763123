from __future__ import annotations

import re

from tidegrid.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    first: dict[tuple, int] = {}
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - 12):
            g = tuple(w[a : a + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for a in range(len(w) - 12):
            if i is not None and first[tuple(w[a : a + 13])] < i:
                gone.update(range(a, a + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def test_against_brute_force(frame, prose):
    shared = prose(1, 40)
    rows = [(k * 7 % 31, prose(k, 20 + k) + " \t" + shared[k * 3 :] + "\n" + prose(k % 5, 30)) for k in range(25)]
    rows += [(100, shared), (101, shared), (102, "  " + shared.replace(" ", "\x0b ")), (50, prose(1, 13)), (51, prose(1, 13)), (52, prose(1, 12))]
    assert got(substring.remove_repeats(frame(rows))) == brute(rows)


def test_repeats_within_a_document_stay(frame, prose):
    rows = [(1, prose(3, 20) + " " + prose(3, 20)), (2, "a " * 60), (3, "a " * 40)]
    assert got(substring.remove_repeats(frame(rows))) == brute(rows)
    assert brute(rows)[0][2] == 0


def test_nulls_equal_ids_and_long_texts(frame, prose):
    long = prose(5, 30000, 5000)
    rows = [(None, prose(9, 30)), (4, prose(9, 30)), (4, prose(9, 30)), (5, None), (6, ""), (7, long), (8, "x " + long), (9, "é" * 4000)]
    assert got(substring.remove_repeats(frame(rows))) == brute(rows)
    assert substring.remove_repeats(frame([])).count() == 0


def test_spans_are_the_removed_words(frame, prose):
    r = substring.remove_repeats(frame([(1, prose(2, 30)), (2, "new words " + prose(2, 30) + " end")])).filter("doc_id = 2").first()
    assert [(s["first"], s["words"]) for s in r.spans] == [(2, 30)]
    assert r.kept == "new words end"


def test_clashing_columns_branches_and_periods(spark, prose):
    a, b, c, d = (prose(k, 40, 4000) for k in (21, 22, 23, 24))
    rows = [(1, f"{a} {b} {c}"), (2, f"{d} {b} {a}"), (3, f"{a} {b} {d}"), (4, b), (5, f"{b[20:]} {c}"), (6, "la " * 50 + b), (7, "la " * 70), (8, f"{a} {b} {c}")]
    df = spark.createDataFrame([(i, t, i, b"x", 1) for i, t in rows], "doc_id long, text string, block long, packed binary, n int").repartition(5)
    assert got(substring.remove_repeats(df)) == brute(rows)
    assert {r[0] for r in brute(rows) if r[2]} == {2, 3, 4, 5, 6, 7, 8}
