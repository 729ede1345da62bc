"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random
from collections import Counter
from functools import cache
from itertools import combinations

import numpy as np
import pytest

from goodsledger.llm import simhash


@cache
def shingles(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    """Of the distinct or the counted shingles, whichever is larger."""
    x, y = shingles(a), shingles(b)
    shared = x.keys() & y.keys()
    both = sum(min(x[s], y[s]) for s in shared)
    return max(len(shared) / (len(x) + len(y) - len(shared)), both / (x.total() + y.total() - both))


def kept_by_brute_force(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {i for i in range(len(texts)) if find(i) == i}


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}


def words(rnd, n):
    return [f"w{rnd.getrandbits(40)}" for _ in range(n)]


def changed(rnd, text, n):
    """The text with ``n`` single words replaced, far enough apart to change five shingles each."""
    out = list(text)
    for at in rnd.sample(range(5, len(out) - 5, 6), n):
        out[at] = f"c{rnd.getrandbits(40)}"
    return out


def test_planted_pairs_from_0_80_to_0_90(spark):
    rnd = random.Random(11)
    texts = []
    for n in [5, 6, 7, 8, 9, 10, 11, 12] * 8:  # 500 words: Jaccard 0.904 down to 0.784
        base = words(rnd, 500)
        texts += [" ".join(base), " ".join(changed(rnd, base, n))]
    close = [jaccard(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.8 <= s < 0.85 for s in close) >= 20 and min(close) < 0.8
    assert kept(spark, texts) == kept_by_brute_force(texts)


def test_sketches_differ_in_no_more_bits_than_their_sets():
    rnd = random.Random(16)
    for n in (0, 1, 5, 40, 400):
        a, b = ({rnd.getrandbits(64) for _ in range(n)} for _ in range(2))
        common = {rnd.getrandbits(64) for _ in range(200)}
        x, y = (simhash.odd_sketch(np.array(sorted(s | common), dtype=np.uint64)) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)


def test_repeated_boilerplate_links_nothing(spark):
    rnd = random.Random(12)
    line = " ".join(words(rnd, 20))
    texts = [" ".join([line] * 20 + words(rnd, 484)) for _ in range(30)]
    assert kept(spark, texts) == set(range(30))


def test_equal_ends_and_lengths_are_no_copies(spark):
    rnd = random.Random(13)
    base = words(rnd, 500)
    texts = [" ".join(base)] + [" ".join(changed(rnd, base, n)) for n in (14, 18, 22, 26) for _ in range(4)]  # 0.75 and less
    assert kept(spark, texts) == kept_by_brute_force(texts) == set(range(17))


@pytest.mark.parametrize("bystanders", [0, 300])
def test_crowded_passages_decide_no_link(spark, bystanders):
    """The same pairs are linked alone and beside many texts that share most of their words."""
    rnd = random.Random(14)
    passage = words(rnd, 300)
    texts = []
    for n in (2, 3, 4, 5, 6, 7, 8) * 2:
        base = passage + words(rnd, 120)
        texts += [" ".join(base), " ".join(changed(rnd, base, n))]
    texts += [" ".join(passage + words(rnd, 120)) for _ in range(bystanders)]
    got = kept(spark, texts)
    assert got == kept_by_brute_force(texts)
    assert len(got) == 14 + bystanders


def test_chains_are_followed_to_the_end(spark):
    """Each revision is close to the one before only; all are one component."""
    rnd = random.Random(15)
    texts = []
    for _ in range(6):
        text, free = words(rnd, 500), list(range(5, 490, 6))
        rnd.shuffle(free)
        for _ in range(12):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(6):
                text[free.pop()] = f"c{rnd.getrandbits(40)}"
    assert jaccard(texts[0], texts[1]) >= 0.85 and jaccard(texts[0], texts[3]) < 0.8
    rnd.shuffle(texts)
    got = kept(spark, texts)
    assert got == kept_by_brute_force(texts)
    assert len(got) == 6
