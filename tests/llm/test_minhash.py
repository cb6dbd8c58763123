from __future__ import annotations

import random
import re

from tidegrid.llm import minhash, queries
from tidegrid.llm.components import components

from .conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def varied(text: str, r: random.Random, changes: int) -> str:
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"z{r.randrange(1000)}"
    return " ".join(w)


def test_against_brute_force(frame, prose):
    r = random.Random(4)
    rows = []
    for k in range(30):
        base = prose(100 + k, 60 + 10 * k, 3000)
        rows += [(len(rows) * 13 % 997, base)]
        for c in range(r.randrange(5)):
            rows.append((1000 + len(rows), varied(base, r, 1 + c * k // 8)))
    assert got(minhash.near_duplicates(frame(rows))) == brute(rows)


def test_chains_of_near_copies(frame, prose):
    r, text, rows = random.Random(8), prose(77, 300, 5000), []
    for k in range(40):
        rows.append((500 - k, text))
        text = varied(text, r, 3)
    assert got(minhash.near_duplicates(frame(rows))) == brute(rows)


def test_a_large_group_of_near_copies(frame, prose):
    r, text = random.Random(2), prose(5, 200, 5000)
    rows = [(k, varied(text, r, k % 3)) for k in range(400)] + [(1000 + k, prose(900 + k, 80, 4000)) for k in range(50)]
    assert got(minhash.near_duplicates(frame(rows))) == brute(rows)


def test_threshold_is_on_full_sets(frame):
    rows = []
    for k in range(40):  # 100 shingles each, and a part of them: at 0.85 linked, at 0.84 not
        words = [f"t{k}x{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 104 - (15 if k % 2 else 16)]))]
    out = got(minhash.near_duplicates(frame(rows)))
    assert out == brute(rows)
    assert [r[2] == r[0] - 1 for r in out if r[0] % 2] == [bool(k % 2) for k in range(40)]


def test_long_lists_of_members_out_of_reach(frame, prose, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 64)
    r, common, rows = random.Random(12), prose(3, 60, 5000), []
    for k in range(900):
        rows.append((k, f"{common} {prose(5000 + k, 40, 9000)}"))
    for k in range(60):  # links inside the long lists
        rows.append((2000 + k, varied(rows[13 * k][1], r, 1 + k % 4)))
    assert got(minhash.near_duplicates(frame(rows))) == brute(rows)


def test_query_against_brute_force(spark, documents):
    assert got(queries.op6_minhash(spark, SMALL)) == brute([(d["doc_id"], d["text"]) for d in documents])


def test_clashing_columns_and_long_texts(spark, prose):
    long = prose(6, 40_000, 9000)
    rows = [(1, long), (2, varied(long, random.Random(3), 300)), (3, prose(7, 40_000, 9000)), (4, long)]
    df = spark.createDataFrame([(i, t, i, "x", 1) for i, t in rows], "doc_id long, text string, node long, component string, n int")
    assert got(minhash.near_duplicates(df)) == brute(rows)


def test_recall_just_above_the_threshold(frame, prose):
    """300 pairs of similarity 0.85 to 0.87: what the signatures miss is at most one."""
    r, rows = random.Random(21), []
    while len(rows) < 600:
        text = prose(7000 + len(rows), 120, 20_000)
        other = varied(text, r, 2)
        a, b = shingles(text), shingles(other)
        if 0.85 <= len(a & b) / len(a | b) < 0.88:
            rows += [(len(rows), text), (len(rows) + 1, other)]
    linked = sum(c != d for d, _, c, _ in got(minhash.near_duplicates(frame(rows))))
    assert linked >= 299


def test_short_null_and_repeated_rows(frame):
    rows = [(1, "Two words"), (2, "two\twords"), (3, "two"), (4, ""), (5, ""), (6, "a b c d e"), (7, "A B  C D E"), (8, "a b c d e f")]
    assert got(minhash.near_duplicates(frame(rows))) == brute(rows)
    out = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame([(9, "x y"), (9, "x y"), (None, "x y"), (3, None)])).collect()}
    assert out == {(9, 9, True), (None, None, True), (3, 3, True)}
    assert minhash.near_duplicates(frame([])).count() == 0


def test_components_of_random_links(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 3), (7, 7)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: find(x) for x in parent}
