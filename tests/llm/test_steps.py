"""Near copies are searched by fingerprints first."""

import random

from goodsledger.llm import simhash
from goodsledger.llm.common import store


def test_near_copies_are_searched_by_fingerprints(spark, monkeypatch):
    """The search took no fingerprint before."""
    seen = []
    plain = simhash.fingerprint_pairs

    def watched(prints, max_bits):
        found = store(plain(prints, max_bits), "test")
        seen.append((prints.collect(), {(r["a"], r["b"]) for r in found.collect()}, max_bits))
        return found

    monkeypatch.setattr(simhash, "fingerprint_pairs", watched)
    rnd = random.Random(5)
    base = [f"w{rnd.getrandbits(40)}" for _ in range(2000)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(base[:60]), "a b c d e f g", "A b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {0, 2, 3}
    ((rows, pairs, bits),) = seen
    value = {r["node"]: r["lanes"][0] & (1 << 64) - 1 for r in rows}
    close = {(a, b) for a in value for b in value if a < b and (value[a] ^ value[b]).bit_count() <= bits}
    assert close and pairs == close
