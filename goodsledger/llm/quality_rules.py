"""Quality rules: simple limits, then the likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed to ``BUCKETS`` counters. Two multinomials are fitted: the raw one on every
document, the target one on trusted rows (a bounded sample, see ``TRUSTED``). A document's score is the mean
log ratio of its hashed words and pairs; it is kept from ``THRESHOLD`` on, whatever the other documents are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, byte_texts, derive, in_arrow, intake, labelled_sample, packed_rows

BUCKETS = 1 << 16
#: Trusted rows of which the target multinomial is fitted at most.
TRUSTED = 20_000
THRESHOLD = -0.1
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MULTIPLIER, PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that is found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = len(numbers)
    _, pairs = np.unique(at[:-2] * size + at[1:-1], return_inverse=True)
    _, windows, counts = np.unique(pairs * size + at[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    inner = text.translate(None, SPACES)
    continued = len(inner) - len(inner.translate(None, CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), len(inner) - continued, symbols, duplicate_lines(text), repeated_words(words)


CONTINUATION = bytes(range(0x80, 0xC0))


def hashed(text: bytes) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    words = text.split()
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    pairs = codes[:-1] * PAIR + codes[1:]
    return ((np.concatenate([codes, pairs]) * MULTIPLIER) >> np.uint64(48)).astype(np.int64) % BUCKETS


def gram_counts(rows: DataFrame, trusted: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all rows, and over the trusted ones. ``BUCKETS`` sums reach the driver."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(trusted)

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(ID)
            marked = pc.is_in(ids, value_set=pa.array(known.value, ids.type)).to_numpy(zero_copy_only=False)
            for text, is_target in zip(byte_texts(batch), marked, strict=True):
                counted = np.bincount(hashed(text), minlength=BUCKETS) if len(text) > BUCKETS else None
                if counted is None:
                    at, n = np.unique(hashed(text), return_counts=True)
                    raw[at] += n
                    if is_target:
                        target[at] += n
                else:
                    raw += counted
                    if is_target:
                        target += counted
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": used, "raw": raw[used], "target": target[used]})

    parts = in_arrow(rows, run, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) by bucket; the target is smoothed by ``BUCKETS`` draws of the raw model."""
    if not target.sum():
        return np.zeros(BUCKETS)
    background = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    return np.log((target + BUCKETS * background) / (target.sum() + BUCKETS) / background)


def judged(rows: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` without the text, with the statistics, ``llr``, ``base_failed`` and ``kept``."""
    sent = rows.sparkSession.sparkContext.broadcast(ratios)

    def build(texts):
        found = list(zip(*map(statistics, texts), strict=True)) or [[]] * 5
        grams = map(hashed, texts)
        return dict(zip(NAMES, found, strict=True)) | {"llr": [float(sent.value[g].mean()) if len(g) else 0.0 for g in grams]}

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    stats = derive(rows, build, ", ".join(f"{n} long" for n in NAMES) + ", llr double")
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def trusted_rows(labels: DataFrame, id_col="doc_id", label_col="quality", bound: int = TRUSTED) -> list:
    """Ids of at most ``bound`` rows marked 1, chosen by a hash of the id."""
    good: Column = F.col("label") == 1
    return [key for key, _ in labelled_sample(labels, id_col, label_col, bound, good)]


def fit(docs: DataFrame, trusted: list, id_col="doc_id", text_col="text") -> np.ndarray:
    return log_ratios(*gram_counts(intake(docs, id_col, text_col), trusted))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", *, threshold=THRESHOLD) -> DataFrame:
    """Per row: id, the five counts, base_failed, llr, kept.

    Null and empty texts have no words and fail. Null ids are judged but never trusted; repeated rows count
    each. Without trusted rows all ratios are 0, so only the limits decide. An empty table gives no rows.
    """
    ratios = fit(docs, trusted_rows(labels, id_col), id_col, text_col)
    return judged(intake(docs, id_col, text_col), ratios, threshold).withColumnRenamed(ID, id_col)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", *, threshold=THRESHOLD) -> DataFrame:
    """The rows that are kept, with all their columns."""
    ratios = fit(docs, trusted_rows(labels, id_col), id_col, text_col)
    return judged(packed_rows(docs, id_col, text_col), ratios, threshold).where("kept").select("row.*")
