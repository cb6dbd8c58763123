"""Language identification by hierarchical discrimination (operator 10).

A text's letters become hashed byte n-gram counts of unit length.  A family is
predicted first (one-versus-one linear support vector machines over families);
machines between the pairs of languages within the family then vote.

The machines are fitted on a bounded sample: at most ``SAMPLE`` distinct texts of
each language, those of the least hashes, so the sample is the same on every run, and
of the ``LANGUAGES`` languages with the most texts.  Texts are turned into features
(16 KB each, however long the text) before they leave the executors.  Prediction
reads whole texts, in one pass and without a shuffle.

Cases: rows that share an id, or have none, are rows like any others; equal texts
of a language are learnt once; a very long text is read whole; a null text or one without a letter is ``und`` with score 0; rows without
a language are not learnt from; a single language is predicted for every text;
without any labelled row everything is ``und``; ties go to the first language in
alphabetical order; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import CHUNK_BYTES, LOWER, text_buffers

#: Labelled texts learnt from, of each language, and languages learnt.
SAMPLE = 400
LANGUAGES = 200
DIMS = 1 << 12
#: Languages of one family; a language not named here is a family of its own.
FAMILIES = {
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk", "bs"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa", "ur"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "mt", "am"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_FOLD = np.where(_LETTER[LOWER], LOWER, 32).astype(np.uint8)


def has_letter(raw: bytes) -> bool:
    b = np.frombuffer(raw, np.uint8)
    if ((LOWER[b] >= 97) & (LOWER[b] <= 122)).any():
        return True
    return bool((b >= 128).any()) and any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def features(raw: np.ndarray) -> np.ndarray:
    """Unit vector of hashed byte bi-, tri- and tetragrams; everything but letters counts as a space."""
    out = np.zeros(DIMS, np.float32)
    for at in range(0, max(1, len(raw)), CHUNK_BYTES):  # pieces overlap, so no n-gram is lost
        b = _FOLD[raw[max(0, at - 3) : at + CHUNK_BYTES]].astype(np.uint32)
        b = np.concatenate([[32], b, [32]]).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        four = three[:-1] * np.uint32(269) + b[3:]
        for g in (two, three, four):
            g = (g * np.uint32(2654435761)) >> np.uint32(20)
            out += np.bincount(g, minlength=DIMS).astype(np.float32)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, reg: float = 1e-4) -> np.ndarray:
    """Weights (the last one the bias) of a linear support vector machine, y in -1, 1; averaged subgradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    w, total, seen = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    order = np.random.default_rng(7)
    step0 = 0
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 32)):
            step0 += 1
            rate = 1 / (reg * (step0 + 1000))
            miss = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - rate * reg
            if len(miss):
                w += rate / len(part) * ((y[miss] * weight[miss]) @ x[miss]) * 0.1
            if step0 > epochs * max(1, len(y) // 32) // 3:
                total += w
                seen += 1
    return (total / seen if seen else w).astype(np.float32)


@dataclass
class Discriminator:
    """Families and the machines between them and within them."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def vote(self, names: list[str], x: np.ndarray) -> tuple[str, float]:
        """The name with most pairwise wins and the least confident of its duels."""
        if len(names) == 1:
            return names[0], 1.0
        wins, conf = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in itertools.combinations(names, 2):
            w = self.machines[a, b]
            p = float(1 / (1 + np.exp(-2 * np.clip(x @ w[:-1] + w[-1], -20, 20))))
            conf[a], conf[b] = min(conf[a], p), min(conf[b], 1 - p)
            wins[a if p >= 0.5 else b] += 1
        best = max(names, key=lambda n: (wins[n], conf[n]))
        return best, conf[best]

    def predict(self, raw: bytes) -> tuple[str, float]:
        if not self.families or not has_letter(raw):
            return "und", 0.0
        x = features(np.frombuffer(raw, np.uint8))
        family, p = self.vote(sorted(self.families), x)
        lang, q = self.vote(self.families[family], x)
        return lang, p * q


def share(h: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11) / float(1 << 53)


def sample(df: DataFrame, per_language: int, text_col: str, lang_col: str) -> list[tuple[str, np.ndarray]]:
    """(language, features) of at most per_language distinct texts with a letter of each language: those of the least hashes."""
    known = df.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    keyed = known.withColumn("h", F.xxhash64("t"))
    largest = keyed.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).orderBy(F.desc("n"), "l").limit(LANGUAGES).select("l", "d")
    # about four times the sample are under this bound, however many texts there are
    near = keyed.select("l", "h").join(F.broadcast(largest), "l").filter(share(F.col("h")) < 4.0 * per_language / F.col("d")).distinct()
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(share(F.col("h")), "h"))).filter(F.col("k") <= per_language).select("l", "h")
    # at most per_language hashes of each of LANGUAGES languages
    one = keyed.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "h").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column(2))
            made = [features(raw[off[i] : off[i + 1]]).tobytes() for i in range(b.num_rows)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["l", "h", "x"])

    rows = one.mapInArrow(run, T.StructType([T.StructField("l", T.StringType()), T.StructField("h", T.LongType()), T.StructField("x", T.BinaryType())])).collect()
    return [(r[0], np.frombuffer(r[2], np.float32)) for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def fit(df: DataFrame, per_language: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> Discriminator:
    """Fit on df's labelled rows; the driver holds the features of the bounded sample alone."""
    rows = sample(df, per_language, text_col, lang_col)
    langs = sorted({r[0] for r in rows})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(_FAMILY.get(lang.lower().split("-")[0], f"~{lang}"), []).append(lang)
    model = Discriminator(families)
    if not rows:
        return model
    x = np.stack([r[1] for r in rows])
    lang = np.array([r[0] for r in rows])
    family = np.array([_FAMILY.get(n.lower().split("-")[0], f"~{n}") for n in lang])
    for names, of in ((sorted(families), family), *((v, lang) for v in families.values())):
        for a, b in itertools.combinations(names, 2):
            pick = (of == a) | (of == b)
            model.machines[a, b] = fit_svm(x[pick], np.where(of[pick] == a, 1.0, -1.0))
    return model


def predict(df: DataFrame, model: Discriminator, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score added (columns of those names are replaced). No shuffle."""
    kept = df.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column(b.schema.get_field_index(text_col)))
            got = [model.predict(raw[off[i] : off[i + 1]].tobytes()) for i in range(b.num_rows)]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.record_batch([*b.columns, *new], names=[*b.schema.names, "lang_pred", "score"])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *extra]))


def fold(id_col: str = "doc_id", of: int = 3) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of
