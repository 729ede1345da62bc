"""Language mixtures: held-out accuracy, a plain EM on a small table, edge rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from goodsledger.llm import languages, queries
from goodsledger.llm.common import fold_of

TEXTS = {
    "en": ["the cat and the dog walk in the park with their friends", "we think that this is what they wanted to have"],
    "de": ["der hund und die katze gehen durch den park mit freunden", "wir denken dass es das ist was sie haben wollten"],
    "fr": ["le chien et le chat marchent dans le parc avec des amis", "nous pensons que cela est ce que vous vouliez avoir"],
}


@pytest.fixture(scope="module")
def speech(spark):
    rows = [(k * 100 + i, TEXTS[lang][i % 2], lang, "x") for k, lang in enumerate(TEXTS) for i in range(20)]
    rows += [(900, None, "en", "x"), (901, "", "de", "x"), (902, "123 ² _ ...", "fr", "x"), (903, TEXTS["fr"][0], None, "x"),
             (None, TEXTS["de"][1], "de", "x"), (904, " ".join(TEXTS["en"] + TEXTS["fr"]), None, "x"), (904, "x" * 100_000, None, "x"),
             (905, "Ω日本 " * 20_000, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, total string").repartition(3)


def slow_counts(docs):
    counts = {}
    for r in docs:
        if r["doc_id"] is None or r["text"] is None or r["lang"] is None or fold_of(r["doc_id"]) == 0:
            continue
        total = counts.setdefault(r["lang"], [Counter() for _ in languages.ORDERS])
        for word in re.findall(r"[^\W\d_]+", r["text"].lower()):
            if not re.search(r"[^\W\d_²]", word):
                continue
            data = f" {word} ".encode()
            for place, order in enumerate(languages.ORDERS):
                for i in range(len(data) - order + 1):
                    if order > 1 or data[i] != 32:
                        code = int.from_bytes(data[i : i + order], "big")
                        total[place][(code * int(languages.MIX) % 2**64 >> 40) % languages.BUCKETS] += 1
    return counts


def test_counts_and_scores_match_plain_loops(speech):
    docs = speech.collect()
    counts = slow_counts(docs)
    langs, model = languages.fit(speech)
    assert langs == sorted(counts)
    table = np.zeros((len(langs), len(languages.ORDERS) * languages.BUCKETS), np.int64)
    for i, lang in enumerate(langs):
        for place, found in enumerate(counts[lang]):
            for bucket, n in found.items():
                table[i, place * languages.BUCKETS + bucket] = n
    assert np.array_equal(model, languages.log_model(table))


def slow_shares(likelihood, times, active):
    """EM with each word by itself."""
    shares = [a / sum(active) for a in active]
    for _ in range(languages.ROUNDS):
        fresh = [0.0] * len(shares)
        for row, n in zip(likelihood, times, strict=True):
            joint = [p * s for p, s in zip(row, shares, strict=True)]
            for i, j in enumerate(joint):
                fresh[i] += n * j / max(sum(joint), 1e-300)
        shares, before = [f / sum(times) for f in fresh], shares
        if max(abs(a - b) for a, b in zip(shares, before, strict=True)) < languages.STILL:
            break
    value = sum(n * math.log(max(sum(p * s for p, s in zip(row, shares, strict=True)), 1e-300)) for row, n in zip(likelihood, times, strict=True))
    return shares, value


def slow_set(likelihood, times):
    size, active = sum(times), [1] * len(likelihood[0])
    shares, _ = slow_shares(likelihood, times, active)
    top = int(np.round(shares, 9).argmax())
    active = [int(s * size >= 0.5 or i == top) for i, s in enumerate(shares)]
    shares, value = slow_shares(likelihood, times, active)
    while sum(active) > 1:
        least = min((round(s, 9), -i) for i, (s, a) in enumerate(zip(shares, active, strict=True)) if a)[1]
        fewer = [a if i != -least else 0 for i, a in enumerate(active)]
        tried, tried_value = slow_shares(likelihood, times, fewer)
        if tried_value + 0.5 * math.log(max(size, 2)) < value:
            break
        active, shares, value = fewer, tried, tried_value
    return shares


def test_mixtures_match_plain_em_of_single_documents(speech):
    langs, model = languages.fit(speech)
    got = {(r["doc_id"], r["lang_pred"], r["languages"]) for r in languages.language_predictions(speech).collect()}
    for r in speech.collect():
        words = languages.words_of(r["text"] or "")
        if not words:
            assert (r["doc_id"], "und", "") in got
            continue
        shares = slow_set(np.exp(languages.word_scores(list(words), model)).tolist(), list(words.values()))
        chosen = ",".join(lang for lang, s in zip(langs, shares, strict=True) if s > 0)
        assert (r["doc_id"], langs[int(np.round(shares, 9).argmax())], chosen) in got


def test_mixed_texts_name_both_languages(speech):
    got = {r["languages"]: r for r in languages.language_predictions(speech).where("doc_id = 904").collect()}
    assert 0.3 < got["en,fr"]["score"] < 0.7


def test_edges(speech):
    got = languages.language_predictions(speech).collect()
    assert len(got) == speech.count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (900, 901, 902))
    assert by_id[903]["lang_pred"] == "fr" and by_id[None]["lang_pred"] == "de" and by_id[None]["held_out"] is False
    assert by_id[905]["lang_pred"] in TEXTS and all(0 <= r["score"] <= 1 for r in got)
    assert languages.language_predictions(speech.where("1 = 0")).count() == 0
    untaught = languages.language_predictions(speech.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}


def test_held_out_accuracy_and_folds(spark, sf_dir, tables):
    truth = {r["doc_id"]: r["lang"] for r in tables["documents"].select("doc_id", "lang").collect()}
    got = queries.op13_languages(spark, sf_dir).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (fold_of(r["doc_id"]) == 0) for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)


def test_held_out_languages_are_not_learned(speech):
    changed = speech.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'zz', lang) as lang")
    (a, x), (b, y) = languages.fit(speech), languages.fit(changed)
    assert a == b and np.array_equal(x, y)


def test_settled_documents_are_not_gone_through_again(monkeypatch):
    """Each round went through the words of all documents, settled or not."""
    likelihood = np.array([[1.0, 1e-9]] * 50 + [[1.0, 0.9], [0.8, 1.0], [1.0, 0.7]])
    times, starts, seen, sums = np.ones(53), np.array([0, 50]), [], languages.across
    monkeypatch.setattr(languages, "across", lambda values: seen.append(len(values)) or sums(values))
    both, fit = languages.mixture(likelihood, times, starts, np.ones((2, 2)))
    assert seen[0] == 53 and seen[-2] == 3 and seen[-1] == 53
    for d, rows in enumerate((slice(0, 50), slice(50, 53))):
        alone, alone_fit = languages.mixture(likelihood[rows], times[rows], np.array([0]), np.ones((1, 2)))
        assert np.array_equal(both[d], alone[0]) and fit[d] == alone_fit[0]
