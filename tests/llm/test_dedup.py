"""Exact and SimHash deduplication."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from goodsledger.llm import exact_dedup, simhash
from goodsledger.llm.common import store


def test_chunks_restore_the_text_and_are_bounded():
    rnd = random.Random(1)
    shared = bytes(rnd.randrange(256) for _ in range(60_000))
    for text in (b"", b"a", b"a" * 100_000, shared, b"another start" + shared):
        chunks = exact_dedup.chunks_of(text)
        assert b"".join(chunks) == text
        assert all(0 < len(c) <= exact_dedup.LARGEST + exact_dedup.SMALLEST for c in chunks)
    common = set(exact_dedup.chunks_of(shared)) & set(exact_dedup.chunks_of(b"another start" + shared))
    assert sum(map(len, common)) > 30_000


def colliding():
    """A digest that is the same for all chunks until the third seed. Made here, so that workers need no test module."""
    return lambda chunk, seed: b"same" if seed < 2 else xxhash.xxh3_128_digest(chunk, seed)


def check_exact(docs, got):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = {}
    for key, text in rows:
        groups.setdefault(text, []).append(key)
    want = Counter()
    for key, text in rows:
        known = [k for k in groups[text] if k is not None]
        want[key, max(known, default=None), len(groups[text]), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    stays = [r for r in got if r["kept"]]
    assert len(stays) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in stays)


def test_exact_duplicates(edge_docs, no_docs):
    check_exact(edge_docs, exact_dedup.exact_duplicates(edge_docs).collect())
    check_exact(edge_docs, exact_dedup.exact_duplicates(edge_docs, digest_of=colliding()).collect())
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_exact_duplicates_dropped(edge_docs):
    kept = exact_dedup.drop_exact_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = Counter(r["text"] or "" for r in kept.collect())
    assert texts == Counter({r["text"] or "" for r in edge_docs.collect()})
    assert {r["doc_id"] for r in kept.collect() if r["text"] == "hello world"} == {2}


def slow_fingerprint(text: str) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in linked:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {v: find(v) for v in values}


def test_simhash_components(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    prints = {text: slow_fingerprint(text) for _, text in rows}
    values = sorted(set(prints.values()))
    pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    root = roots(values, pairs)
    least = {}
    for key, text in rows:
        if key is not None:
            least[root[prints[text]]] = min(key, least.get(root[prints[text]], key))
    want = Counter((key, format(prints[text], "016x"), least.get(root[prints[text]])) for key, text in rows)
    got = simhash.simhash_components(edge_docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.simhash_components(no_docs).count() == 0


def dense_prints(seed: int, n: int) -> list[int]:
    """Fingerprints a few bits from three centres, so that keys are crowded."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    found = set(centres)
    while len(found) < n:
        value = rnd.choice(centres)
        for bit in rnd.sample(range(64), rnd.randint(1, 4)):
            value ^= 1 << bit
        found.add(value)
    return sorted(found)


def signed(values):
    return np.array(values, dtype=np.uint64).view(np.int64).tolist()


def test_crowded_keys_are_split_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    values = dense_prints(5, 120)
    prints = store(spark.createDataFrame([(n, [v]) for n, v in enumerate(signed(values))], "node long, lanes array<long>"), "test")
    got = [(r["a"], r["b"]) for r in simhash.close_pairs(prints, 1, 2, 2, 2).collect()]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (values[i] ^ values[j]).bit_count() <= 2}
    assert len(got) == len(set(got))
    assert set(got) == want
    assert len(want) > 100


def test_lanes_find_every_pair_with_a_close_lane(spark):
    values = dense_prints(6, 80)
    rows = [(n, signed([v, values[-n]])) for n, v in enumerate(values)]
    lanes = [np.array(r[1], dtype=np.int64).view(np.uint64).tolist() for r in rows]
    prints = store(spark.createDataFrame(rows, "node long, lanes array<long>"), "test")
    got = {(r["a"], r["b"]) for r in simhash.close_pairs(prints, 2, 4, 4, 24).collect()}
    apart = {(i, j): [(x ^ y).bit_count() for x, y in zip(lanes[i], lanes[j], strict=True)] for i in range(80) for j in range(i + 1, 80)}
    close = {pair for pair, bits in apart.items() if sum(bits) <= 24}
    assert got <= close
    assert got >= {pair for pair in close if min(apart[pair]) <= 4}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 140), (7, 3), (3, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    values = {v for link in links for v in link}
    assert got == roots(sorted(values), links)


def test_near_duplicates_dropped(edge_docs):
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [r["text"] for r in kept.collect()]
    prose = [t for t in texts if t and t.startswith("The quick")]
    assert len(prose) == 1
    assert texts.count("hello world") == 1
    assert "other text of seven" in texts
