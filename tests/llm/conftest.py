from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", " \t\n", "one", "Ünïcödé ΣΑΣ ﬁ 漢字 🙂 é", "a\x1cb\x85c d e", "x" * 5000, "<|endoftext|> a<|startoftext|>b", "it's we'll  two   spaces \n\n lines ", "\x00\x01 \x7f"]


@pytest.fixture(scope="session")
def documents() -> list[dict]:
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


@pytest.fixture
def frame(spark):
    """A documents table of (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)

    return make


@pytest.fixture
def prose():
    """Random words of a small vocabulary, so that windows repeat."""

    def make(seed: int, n: int, words: int = 40) -> str:
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(words)}" for _ in range(n))

    return make
