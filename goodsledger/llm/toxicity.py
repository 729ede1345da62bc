"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, the beginnings of longer words (so that inflected forms meet), pairs of
neighbours, and pairs with one word between, hashed to ``SIZE`` coordinates. Each coordinate has its own learning rate; the L1 term leaves most weights at zero, so the model
is a short list that can be broadcast whatever the corpus. It is fitted on a bounded sample of labelled rows
(``SAMPLE``), whose features meet in one task because the updates are sequential; every document is scored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, derive, held_out, intake, labelled_sample, sample_texts

SIZE = 1 << 18
#: Labelled rows that are learned from at most.
SAMPLE = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 8.0, 0.5, 4
#: Bytes of a word's beginning that count as a feature where the word is longer.
STEMS = (4, 5)
CUT = 0.5
#: Letters, digits and bytes of longer characters are words; A-Z become small.
TO_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)
FIRST, SECOND, SKIP, STEM = map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def features(text: bytes) -> np.ndarray:
    """Distinct coordinates of a text; 0 is the intercept and always among them."""
    words = text.translate(TO_WORDS).split()
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    stems = [
        np.fromiter((zlib.crc32(w[:k]) for w in words if len(w) > k), np.uint64) * STEM + np.uint64(k) for k in STEMS
    ]
    grams = np.concatenate([codes, codes[:-1] * SECOND + codes[1:], codes[:-2] * SKIP + codes[2:], *stems])
    at = (grams * FIRST >> np.uint64(32)) % np.uint64(SIZE - 1) + np.uint64(1)
    return np.concatenate([np.zeros(1, np.int32), np.unique(at.astype(np.int32))])


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes in the given order."""
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    for _ in range(epochs):
        for at, label in rows:
            w = weights_of(z[at], n[at])
            gradient = sigmoid(w.sum()) - label
            squared = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squared
    return weights_of(z, n)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights, zero where nothing was learned. Only rows outside the held-out fold are read."""
    rows = intake(docs, id_col, text_col)
    chosen = labelled_sample(labels, id_col, label_col, sample, ~held_out(F.col(ID)))
    if not chosen:
        return np.zeros(SIZE)
    coded = derive(sample_texts(rows, chosen), lambda texts: {"at": [features(t) for t in texts]}, "at array<int>")

    def learn(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("place", "ascending"), ("label", "ascending")]))
        at = table["at"].combine_chunks()
        rows = [(at[i].values.to_numpy(), y) for i, y in enumerate(table["label"].to_pylist())]
        w = ftrl(rows)
        used = np.flatnonzero(w)
        return pa.table({"at": used.astype(np.int32), "weight": w[used]})

    ordered = coded.withColumn("place", F.xxhash64(F.lit("order"), ID)).drop(ID).withColumn("model", F.lit(0))
    learned = ordered.groupBy("model").applyInArrow(learn, "at int, weight double")
    weights = np.zeros(SIZE)
    for row in learned.collect():  # at most SIZE
        weights[row["at"]] = row["weight"]
    return weights


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", *, sample=SAMPLE
) -> DataFrame:
    """Per row: id, held_out, score, predicted (score of 0.5 or more).

    Null and empty texts get the intercept's score; without labels every score is 0.5. Null ids are scored,
    never learned from and not held out. Repeated rows get equal scores; an id that repeats is one example.
    An empty table gives no rows.
    """
    weights = fit(docs, labels, id_col, text_col, label_col, sample)
    rows = intake(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def build(texts):
        return {"score": [float(sigmoid(sent.value[features(t)].sum())) for t in texts]}

    scored = derive(rows, build, "score double")
    return scored.select(
        F.col(ID).alias(id_col), held_out(F.col(ID)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )

