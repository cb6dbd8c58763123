from __future__ import annotations

import random
import re

import pytest

from tidegrid.llm import decontaminate, queries

from .conftest import SMALL

TOKEN = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")


def tokens(text):
    return [x.translate({i: i + 32 for i in range(65, 91)}) for x in TOKEN.findall(text or "")]


def brute(item, doc, k=5):
    """Greedy string tiling by the book: the longest unmarked common run first, of those the first in doc, then in item."""
    a, b = [False] * len(item), [False] * len(doc)
    places = {}
    for i in range(len(item) - k + 1):
        places.setdefault(tuple(item[i : i + k]), []).append(i)
    while True:
        best = (k - 1, 0, 0)
        for j in range(len(doc) - k + 1):
            for i in places.get(tuple(doc[j : j + k]), ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return sum(a) / max(1, len(item))
        for x in range(n):
            a[i + x] = b[j + x] = True


def judged(docs, bench):
    """(doc_id, n_tokens, n_items, item_id, coverage, contaminated) of every row, item by item."""
    out = []
    for d, text in docs:
        t = tokens(text)
        grams = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        share = [(brute(x, t), -i) for i, x in ((i, tokens(y)) for i, y in bench if i is not None) if any(tuple(x[k : k + 5]) in grams for k in range(len(x) - 4))]
        share = sorted(s for s in share if s[0] >= decontaminate.COVERAGE)
        out.append((d, len(t), len(share), -share[-1][1] if share else None, share[-1][0] if share else 0.0, bool(share)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_items, r.item_id, r.coverage, r.contaminated) for r in df.collect()), key=repr)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("seed", range(40))
def test_tiling_is_the_plain_algorithm(seed):
    r = random.Random(seed)
    item = [f"w{r.randrange(2 + seed // 4)}" for _ in range(40)]
    doc = item[20:33] + [f"w{r.randrange(2 + seed // 4)}" for _ in range(20)] + item[3:15] + item[:9] * (seed % 3)
    (_, x, _), *_ = decontaminate.token_chunks(decontaminate.pa.array([" ".join(item)]))
    (_, y, _), *_ = decontaminate.token_chunks(decontaminate.pa.array([" ".join(doc)]))
    assert float(decontaminate.tile(x, y).mean()) == pytest.approx(brute(item, doc), abs=1e-12)


def test_repetitive_texts_are_tiled_in_linear_memory():
    (_, x, _), *_ = decontaminate.token_chunks(decontaminate.pa.array(["la " * 500]))
    (_, y, _), *_ = decontaminate.token_chunks(decontaminate.pa.array(["la " * 300 + "lu " + "la " * 200_000]))
    assert decontaminate.tile(x, y).all()


@pytest.mark.parametrize("n", range(5, 60))
def test_the_threshold_is_a_share(n):
    m = decontaminate.needed(n)
    assert m / n >= decontaminate.COVERAGE > (m - 1) / n


def cases(prose):
    bench = [(k, prose(500 + k, 40, 4000)) for k in range(8)] + [(20, "too short"), (21, None), (22, "")]
    whole, w = bench[2][1], bench[5][1].split()
    docs = [
        (1, prose(1, 50, 4000) + " " + whole + " " + prose(2, 50, 4000)),
        (2, " ".join(w[20:40] + ["between"] + w[:20])),  # reordered
        (3, " ".join(w[:20]) + " " + prose(3, 60, 4000)),  # half of it
        (4, prose(4, 200, 4000)), (5, None), (6, ""), (7, whole.upper().replace(" ", ", ")), (7, whole), (None, whole),
    ]
    return docs, bench


def test_planted_passages(frame, items, prose):
    docs, bench = cases(prose)
    out = sorted(((r.doc_id, r.item_id) for r in decontaminate.judge(frame(docs), items(bench)).collect() if r.contaminated), key=repr)
    assert out == sorted([(1, 2), (2, 5), (7, 2), (7, 2), (None, 2)], key=repr)


def test_against_the_plain_algorithm(frame, items, prose):
    """Common seeds, items of one period, equal ids, ties, and a very long text."""
    docs, bench = cases(prose)
    common = "the same five words stand here in every text"
    bench += [(30, f"{common} {prose(90, 12, 4000)}"), (31, common), (31, common), (32, "do re " * 30), (33, prose(91, 60, 4000)), (None, common)]
    docs += [(100 + k, f"{prose(k, 10, 4000)} {common} {prose(k + 50, 10, 4000)}") for k in range(20)]
    docs += [(200, "do re " * 12), (201, "do re " * 25), (202, prose(91, 60, 4000)[:150] + " x " + bench[0][1]), (203, prose(92, 40_000, 4000) + " " + bench[-2][1])]
    assert got(decontaminate.judge(frame(docs), items(bench))) == judged(docs, bench)


def test_empty_sides(frame, items):
    assert decontaminate.judge(frame([]), items([(1, "a b c d e f")])).count() == 0
    r = decontaminate.judge(frame([(1, "a b c d e f g")]), items([])).first()
    assert (r.n_tokens, r.n_items, r.coverage, r.contaminated) == (7, 0, 0.0, False)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "z"), (2, "q", 6, "y")], "doc_id long, text string, row long, seeds string")
    bench = spark.createDataFrame([(4, "A, b. C d e f", "u", 1.0)], "item_id long, text string, item string, need double")
    assert got(decontaminate.judge(docs, bench)) == judged([(1, "a b c d e f"), (2, "q")], [(4, "A, b. C d e f")])


def test_query_is_the_plain_algorithm(spark, documents):
    import pyarrow.parquet as pq

    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    assert got(queries.op8_decontaminate(spark, SMALL)) == judged([(d["doc_id"], d["text"]) for d in documents], bench)
