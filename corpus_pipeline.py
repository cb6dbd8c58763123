"""From raw documents to token ids: five stages, each over all that the one before kept.

1. ``language``: documents without a language go.  The discriminator names one of the
   learnt languages for every text with a letter, so these are the texts without a
   letter; how sure it is decides nothing.
2. ``near_duplicates``: of each component of near copies the least document stays.
3. ``decontaminate``: documents that cover a benchmark item go.
4. ``private``: personal data is replaced by its kind in brackets.
5. ``encode``: every text becomes ids, and is decoded again from them.

A stage's output is written as Parquet in the shared folder and read as the next
one's input; then what the stage wrote on its way is deleted.  Null texts have no language and go in stage 1; rows that share an id
and a component's least id all stay in stage 2; a very long text is treated whole by
every stage; columns beside those of documents are dropped, whatever their names; an
empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontaminate, langid, minhash, pii
from tidegrid.llm.blocks import text_bytes
from tidegrid.llm.queries import WORD_VOCABULARY
from tidegrid.llm.session import compact, forget, made, small_batches, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _compact(out: DataFrame, docs: DataFrame) -> DataFrame:
    """A stage's rows in few files, however many partitions its joins had: the next stage opens each of them."""
    return compact(out, text_bytes(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.fit(docs.filter(langid.fold("doc_id", 3) != 1))
    if not model.families:  # nothing is labelled: what has a letter stays all the same
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    return _compact(langid.predict(docs.select(*COLUMNS), model).filter("lang_pred <> 'und'").select(*COLUMNS), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    keyed = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(keyed).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return _compact(keyed.join(gone, keyed.doc_id == gone["_gone"], "left_anti"), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    bad = decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    keyed = docs.select(*COLUMNS)
    return _compact(keyed.join(bad, keyed.doc_id == bad["_bad"], "left_anti"), docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _compact(pii.redact(docs.select(*COLUMNS)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.round_trip(docs, WORD_VOCABULARY).select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", without_benchmark), ("private", private), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained stage cannot be said in SQL.
ORACLE_SQL = None
