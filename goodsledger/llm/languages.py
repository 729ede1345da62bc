"""Language identification of texts that may mix languages.

Words are scored by models of byte n-grams, one multinomial per order and language, counted over every learnable
document. Expectation-maximisation estimates the share of each language among a document's words; languages are
then dropped one by one, least share first, as long as the likelihood less a charge per language improves.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, TEXT, derive, held_out, in_arrow, intake, quoted

ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 15
#: Distinct languages a model holds at most: it is broadcast, and a language takes half a megabyte.
LANGUAGES = 1000
#: Weight of the languages' common model in each language's own.
SHARED = 0.05
ROUNDS, STILL = 12, 1e-3
UNKNOWN = "und"
#: Texts are worked on in groups of about this many bytes.
GROUP_BYTES = 2 << 20
WORD = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> Counter:
    """Counts of the runs of letters, in small letters. Runs of other numerals, which hold no letter, are no words."""
    found = Counter(WORD.findall(text.lower()))
    if not "".join(found).isalpha():
        for word in [w for w in found if not w.isalpha() and not any(map(str.isalpha, w))]:
            del found[word]
    return found


def grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order the number of the word and the bucket of each n-gram. A word's two ends count as a space."""
    data = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    ends = np.cumsum(data == 32)
    made = []
    for place, order in enumerate(ORDERS):
        count = len(data) - order + 1
        code = np.zeros(max(count, 0), np.uint64)
        for shift in range(order):
            code = (code << np.uint64(8)) | data[shift : shift + count]
        inside = data[:count] != 32 if order == 1 else ends[order - 2 : order - 2 + count] == ends[:count]
        at = np.flatnonzero(inside)
        bucket = ((code[at] * MIX) >> np.uint64(40)).astype(np.int64) % BUCKETS + place * BUCKETS
        made.append((ends[at] - 1, bucket))
    return made


def text_groups(texts: list[bytes]):
    """Consecutive texts of together about ``GROUP_BYTES``, at least one."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_BYTES:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def gram_counts(rows: DataFrame) -> DataFrame:
    """place (bucket within its order), lang, total over all ``rows`` (text, lang)."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column(TEXT).cast(pa.binary()).to_pylist()
            done = 0
            for group in text_groups(texts):
                spoken: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[done : done + len(group)], group, strict=True):
                    spoken.setdefault(lang, []).append(text)
                done += len(group)
                for lang, said in spoken.items():
                    # a line break ends a word like the end of a text
                    counted = words_of(b"\n".join(said).decode())
                    total = counts.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                    times = np.fromiter(counted.values(), np.float64, len(counted))
                    for word, bucket in grams(list(counted)):
                        total += np.bincount(bucket, times[word], len(total)).astype(np.int64)
        for lang, total in counts.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "place": pa.array(used), "total": pa.array(total[used])})

    parts = in_arrow(rows, run, "lang string, place long, total long")
    return parts.groupBy("lang", "place").agg(F.sum("total").alias("total"))


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities by place and language, from counts by language and place; orders are averaged."""
    parts = []
    for order in np.split(counts.astype(np.float64), len(ORDERS), axis=1):
        own = order / np.maximum(order.sum(1, keepdims=True), 1)
        common = (own.sum(0) + 1 / BUCKETS) / (len(own) + 1)
        parts.append(np.log((1 - SHARED) * own + SHARED * common))
    return (np.concatenate(parts, axis=1) / len(ORDERS)).T.astype(np.float32)


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> tuple[list[str], np.ndarray]:
    """The learned languages in order and their model. Held-out rows, and rows without id, text or language, teach nothing."""
    rows = docs.select(
        F.col(quoted(id_col)).alias(ID), F.col(quoted(text_col)).cast("string").alias(TEXT), F.col(quoted(lang_col)).cast("string").alias("lang")
    )
    rows = rows.where(F.col(ID).isNotNull() & F.col(TEXT).isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col(ID)))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in column {lang_col}")
    counts = np.zeros((len(langs), len(ORDERS) * BUCKETS), np.int64)
    if langs:
        found = gram_counts(rows.select(TEXT, "lang")).toArrow()
        at = np.searchsorted(langs, found["lang"].to_pylist()) if found.num_rows else []
        counts[at, found["place"].to_numpy()] = found["total"].to_numpy()
    return langs, log_model(counts) if langs else np.zeros((len(ORDERS) * BUCKETS, 0), np.float32)


def word_scores(words: list[str], model: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language, less its largest one."""
    scores = np.zeros((len(words), model.shape[1]))
    for word, bucket in grams(words):
        for lang in range(model.shape[1]):
            scores[:, lang] += np.bincount(word, model[bucket, lang], len(words))
    return scores - scores.max(1, keepdims=True)


def mixture(likelihood, times, starts, active) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log likelihood per document over its ``active`` languages.

    ``likelihood`` and ``times`` have a row per distinct word, documents one after the other from ``starts``.
    """
    lengths = np.diff(np.append(starts, len(times)))
    shares = active / active.sum(1, keepdims=True)
    # the documents whose shares still move, with their words; the others' words are not gone through again
    moving, words, counts, begins, sizes = np.arange(len(starts)), likelihood, times, starts, lengths
    for _ in range(ROUNDS):
        joint = np.repeat(shares[moving], sizes, axis=0)
        joint *= words
        joint *= (counts / np.maximum(across(joint), 1e-300))[:, None]
        fresh = np.add.reduceat(joint, begins) / np.add.reduceat(counts, begins)[:, None]
        change = np.abs(fresh - shares[moving]).max(1)
        shares[moving] = fresh
        still = change >= STILL
        if not still.any():
            break
        if not still.all():
            kept = np.repeat(still, sizes)
            moving, words, counts, sizes = moving[still], words[kept], counts[kept], sizes[still]
            begins = np.cumsum(sizes) - sizes
    inner = np.log(np.maximum(across(likelihood * np.repeat(shares, lengths, axis=0)), 1e-300))
    return shares, np.add.reduceat(times * inner, starts)


def across(values: np.ndarray) -> np.ndarray:
    """Sums over the languages, added in order; whole columns at a time, as a row is short."""
    total = values[:, 0].copy()
    for lang in range(1, values.shape[1]):
        total += values[:, lang]
    return total


def largest(shares: np.ndarray) -> np.ndarray:
    """The language with the largest share of each row; shares equal to nine places go to the first in order."""
    return np.round(shares, 9).argmax(1)


def language_sets(likelihood, times, starts) -> np.ndarray:
    """Shares of the selected languages per document.

    A language is charged half the logarithm of the number of words. First all languages with less than half a
    word go at once, then the one with the least share, as long as the charged likelihood does not fall.
    """
    size = np.add.reduceat(times, starts)
    charge = 0.5 * np.log(np.maximum(size, 2))
    active = np.ones((len(starts), likelihood.shape[1]))
    shares, _ = mixture(likelihood, times, starts, active)
    large = shares * size[:, None] >= 0.5
    large[np.arange(len(starts)), largest(shares)] = True
    active = large.astype(float)
    shares, fit = mixture(likelihood, times, starts, active)
    lengths = np.diff(np.append(starts, len(times)))
    todo = np.flatnonzero(active.sum(1) > 1)
    while len(todo):
        rows = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in todo])
        inner = np.concatenate([[0], np.cumsum(lengths[todo])[:-1]])
        fewer = active[todo].copy()
        least = largest(np.where(fewer > 0, -shares[todo], -np.inf)[:, ::-1])
        fewer[np.arange(len(todo)), fewer.shape[1] - 1 - least] = 0
        tried, tried_fit = mixture(likelihood[rows], times[rows], inner, fewer)
        better = tried_fit + charge[todo] >= fit[todo]
        won = todo[better]
        active[won], shares[won], fit[won] = fewer[better], tried[better], tried_fit[better]
        todo = won[active[won].sum(1) > 1]
    return shares


def shares_of(texts: list[bytes], model: np.ndarray) -> list[np.ndarray | None]:
    """Language shares per text, None for a text without letters."""
    counted = [words_of(t.decode()) for t in texts]
    filled = [i for i, c in enumerate(counted) if c]
    if not filled or not model.shape[1]:
        return [None] * len(texts)
    words = pa.array([w for c in counted for w in c], pa.large_string()).dictionary_encode()
    likelihood = np.exp(word_scores(words.dictionary.to_pylist(), model))
    times = np.concatenate([np.fromiter(counted[i].values(), np.float64, len(counted[i])) for i in filled])
    starts = np.cumsum([0] + [len(counted[i]) for i in filled[:-1]])
    found: list[np.ndarray | None] = [None] * len(texts)
    for i, shares in zip(filled, language_sets(likelihood[words.indices.to_numpy()], times, starts), strict=True):
        found[i] = shares
    return found


def language_predictions(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (share of the predicted language), languages (selected, in order).

    Null and empty texts, and texts without a letter, are ``und`` with score 0, as is every text where no row
    teaches a language. Equal shares go to the language first in order. Rows without id are predicted, never
    learned from and not held out. Repeated rows count and are predicted each. An empty table gives no rows.
    """
    langs, model = fit(docs, id_col, text_col, lang_col)
    rows = intake(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast((langs, model))

    def build(texts):
        langs, model = sent.value
        found = [shares for group in text_groups(texts) for shares in shares_of(group, model)]
        best = [None if s is None else int(largest(s[None])[0]) for s in found]
        return {
            "lang_pred": [UNKNOWN if b is None else langs[b] for b in best],
            "score": [0.0 if b is None else min(float(s[b]), 1.0) for b, s in zip(best, found, strict=True)],
            "languages": ["" if s is None else ",".join(langs[i] for i in np.flatnonzero(s > 0)) for s in found],
        }

    made = derive(rows, build, "lang_pred string, score double, languages string")
    return made.select(F.col(ID).alias(id_col), held_out(F.col(ID)).alias("held_out"), "lang_pred", "score", "languages")
