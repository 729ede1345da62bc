"""Best catalog text of a name: as by a full scan, and few texts are measured."""

import random

import numpy as np

from goodsledger.operators import catalog as catalogs
from goodsledger.operators import nearest


def _full_scan(names, texts, places):
    out = {}
    for name in names:
        score, place = min((-nearest.similarity(name, t), p) for t, p in zip(texts, places))
        if score < 0:
            out[name] = (score, *place)
    return out


def _texts(rng, count):
    made = {"".join(rng.choices("ab 12", k=rng.choice([1, 3, 6, 12]))) for _ in range(count)}
    # longer than one and than two machine words
    made |= {"".join(rng.choices("abcдё 1", k=rng.choice([63, 64, 65, 140]))) for _ in range(count // 5)}
    return sorted(made)


def test_block_equals_full_scan(monkeypatch):
    rng = random.Random(3)
    texts, names = _texts(rng, 120), _texts(rng, 60) + ["zzz", "a" * 70]
    names = sorted(set(names))
    rng.shuffle(texts)
    places = [(rng.randrange(40), k % 4) for k in range(len(texts))]
    want = _full_scan(names, texts, places)
    # contained texts, which score above their common subsequence, are another step's
    inner = {n: _full_scan([n], *zip(*c)) for n in names if (c := [(t, p) for t, p in zip(texts, places) if n in t or t in n])}

    def search(needed):
        got = {name: found for name, *found in nearest.best_in_block(names, needed, texts, places)}
        both = {n: min(tuple(f) for f in (got.get(n), inner.get(n, {}).get(n)) if f) for n in names if n in got or n in inner}
        return both

    for limit in (nearest.PLACES, 50):
        monkeypatch.setattr(nearest, "PLACES", limit)
        assert search([0.0] * len(names)) == want
    # with the best score as level, names still find it
    known = [-want.get(n, (0.0,))[0] for n in names]
    assert search(known) == want


def test_numbered_names_meet_few_texts(spark, monkeypatch):
    measured = []
    monkeypatch.setattr(nearest, "similarity", lambda a, b: measured.append(b) or nearest.SequenceMatcher(None, a, b).ratio())
    texts = [f"num {k}" for k in range(10_000, 14_000)]
    names = [f"unlisted {k}" for k in range(10_000, 14_000, 4)]
    got = nearest.best_in_block(names, [14 / 23] * len(names), texts, [(k, 0) for k in range(len(texts))])
    assert sorted(got) == [(n, -14 / 23, 4 * k, 0) for k, n in enumerate(names)]
    assert len(measured) <= 2 * len(names), len(measured)


def test_blocks_and_parts_equal_full_scan(spark, monkeypatch):
    monkeypatch.setattr(catalogs, "BLOCK", 30)
    rng = random.Random(8)
    texts, names = _texts(rng, 90), _texts(rng, 40)
    places = [(k // 3, k % 3) for k in range(len(texts))]
    table = spark.createDataFrame([(t, *p) for t, p in zip(texts, places)], "text string, entity_pos long, field_pos int")
    got = catalogs.best_texts(spark.createDataFrame([(n,) for n in names], "q string"), table).collect()
    want = _full_scan(names, texts, places)
    assert {r.q: (r.entity_pos, r.field_pos) for r in got} == {n: w[1:] for n, w in want.items()}
    assert np.allclose([r.score for r in sorted(got)], [-want[r.q][0] for r in sorted(got)])
