from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm.session import written

from .conftest import DOCS, SMALL
from .test_minhash import brute as brute_near
from .test_pii import brute as brute_pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), f"test-{name}")
        out[name] = docs.collect()
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name in list(stages)[:-1]:
        assert stages[name][0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_what_has_letters(stages, documents):
    kept = {r.doc_id for r in stages["language"]}
    assert not kept & {d["doc_id"] for d in documents if not any(c.isalpha() for c in d["text"] or "")}
    assert len(kept) >= 0.95 * len([d for d in documents if any(c.isalpha() for c in d["text"] or "")])


def test_one_document_of_each_group_stays(stages):
    want = {d for d, _, _, kept in brute_near([(r.doc_id, r.text) for r in stages["language"]]) if kept}
    assert {r.doc_id for r in stages["near_duplicates"]} == want


def test_contaminated_documents_go(stages, spark):
    before = {r.doc_id: r.text for r in stages["near_duplicates"]}
    after = {r.doc_id for r in stages["decontaminate"]}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    gone = {i for i, t in before.items() if any(x and x in t for x in items)}
    assert gone and not gone & after
    assert len(after) > 0.8 * len(before)


def test_personal_data_is_gone(stages):
    assert not any(brute_pii(r.text) for r in stages["private"])
    assert len(stages["private"]) == len(stages["decontaminate"])
    assert all(r.n_chars == len(r.text) for r in stages["private"])


def test_encoding_is_the_library_s(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in stages["private"]}
    assert {r.doc_id for r in stages["encode"]} == set(text)
    for r in stages["encode"]:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_leaves_one_table(spark):
    from tidegrid.shared import shared_dir

    where = Path(shared_dir(spark).removeprefix("file://"))
    before = set(where.iterdir())
    out = corpus_pipeline.run(spark, SMALL)
    assert [p.name.split("-")[1] for p in set(where.iterdir()) - before] == ["private"]
    assert out.count()


def test_run_is_the_stages_in_order(stages, spark):
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "ids_sha256").collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in stages["encode"]}


def test_odd_tables(spark):
    rows = [(1, None, None, None, None), (None, "some words without an id here", "en", "s", 29), (3, "same text of five words", "en", "s", 1), (3, "same text of five words", "en", None, None), (4, "", "en", "s", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, DOCS)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs.withColumns({x: docs.doc_id for x in ("extra", "row", "h", "node", "lang_pred", "_row", "spans", "ids")}), SMALL), f"odd-{name}")
        assert docs.count() == (3 if data else 0)
