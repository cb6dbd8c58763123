"""The registered queries of the training-data operators, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, media, minhash, ngram, pii, substring, tokenfile, toxicity
from .session import small_batches, table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_VOCABULARY).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.shown("base"), 256).alias("base_sha256"), pii.shown("spans").alias("spans"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    shards = tokenfile.write(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)
    read = tokenfile.read(shards).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return read.join(tokenfile.starts(shards), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the id of " the": how often, and its first and last place, by rank and select on the files of operator 4."""
    small_batches(spark)
    token = int.from_bytes(tokenfile.byte_bpe(BYTE_VOCABULARY).encode([" the"])[0][:4], "little")
    return tokenfile.lookup(tokenfile.write(table(spark, sf_dir, "documents"), BYTE_VOCABULARY), token).select("doc_id", "n", "first", "last")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    stored = media.encode(table(spark, sf_dir, "documents"))
    return media.decode(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.filter(langid.fold("doc_id", 3) != 1)
    net = toxicity.fit(train, table(spark, sf_dir, "labels").filter(langid.fold("doc_id", 3) != 1))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram.score(docs, langid.fold("doc_id", 10) == 0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(langid.fold("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring": op2_substring,
    "op3_pii": op3_pii,
    "op4_token_file": op4_token_file,
    "token_lookup": token_lookup,
    "op5_media": op5_media,
    "op6_minhash": op6_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_ngram": op9_ngram,
    "op10_language": op10_language,
}
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) u(i)),
        src AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
        hit AS (SELECT doc_id, list(i) AS starts FROM win JOIN src USING (g) WHERE m < doc_id GROUP BY doc_id),
        cover AS (SELECT DISTINCT doc_id, a + k AS p FROM (SELECT doc_id, unnest(starts) AS a FROM hit), range(13) r(k)),
        gone AS (SELECT doc_id, list(p) AS ps FROM cover GROUP BY doc_id),
        j AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]), ' '), '')) AS kept_sha256
        FROM j""",
}
