import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from goodsledger.llm import bpe_tables
from goodsledger.llm.packing import Stock, cut, pack_documents, pack_pieces, plan_packing, reduce_by_dominance


def contents(plan):
    got = Counter()
    for number, items in plan:
        for length, copies in items:
            got[length] += number * copies
    return got


def fewest(lengths, capacity):
    """Exact number of sequences by search over all ways to place each length."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_plan_holds_every_length_and_the_reduction_costs_no_sequence(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 20, 30])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 9))]
    plan = plan_packing(dict(Counter(lengths)), capacity)
    assert contents(plan) == Counter(lengths)
    assert all(n > 0 and sum(length * k for length, k in items) <= capacity for n, items in plan)
    stock = Stock(dict(Counter(lengths)))
    fixed = reduce_by_dominance(stock, capacity)
    rest = [length for length, n in stock.count.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)


def test_plan_size_does_not_depend_on_the_counts():
    counts = {length: 10**9 + length for length in range(1, 2049)}
    plan = plan_packing(counts, 2048)
    assert contents(plan) == Counter(counts)
    assert len(plan) < 3 * 2048
    assert sum(n for n, _ in plan) <= 1.001 * sum(length * n for length, n in counts.items()) / 2048


def test_only_the_first_piece_is_shorter():
    assert cut(5, 4) == [(0, 1), (1, 4)]
    assert cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(3, 4) == [(0, 3)]


def check_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packed_documents_match_the_tokenizer(spark, edge_docs, no_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_documents(edge_docs, capacity=512).collect()
    check_places(rows, 512)
    want = Counter()
    for r in edge_docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, (start, length) in enumerate(cut(len(ids), 512)):
            want[r["doc_id"], piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert pack_documents(no_docs).count() == 0


def test_marks_of_the_tokenizer_file_are_tokens():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder, marks = bpe_tables.encoding(bpe_tables.rank_file(bpe_tables.ranks_path())), bpe_tables.added_tokens()
    for text in ("", "<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>x <|endoftext", "it's\n <|endoftext|>'s <|ENDOFTEXT|>"):
        assert bpe_tables.encode_marked(coder, text, marks) == tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_texts_are_split_by_the_other_engine_alike():
    coder = bpe_tables.encoding(bpe_tables.rank_file(bpe_tables.ranks_path()))
    text = "It's a test, naïve 123  \n\n and more; " * 40
    words = [m.group() for m in bpe_tables.splitter().finditer(text)]
    assert [i for w in words for i in bpe_tables.encode_word(coder, w)] == bpe_tables.encode_text(coder, text)


def test_a_hot_length_is_ranked_in_parts(spark):
    pieces = spark.range(30_000).selectExpr("id", "cast(if(id % 3 = 0, 100, id % 512 + 1) as bigint) as length", "'c' as salt")
    rows = pack_pieces(pieces.drop("salt"), 512).collect()
    assert len(rows) == 30_000
    used = check_places(rows, 512)
    assert used <= 1.01 * sum(r["length"] for r in rows) / 512 + 1


def test_lengths_beyond_the_capacity_are_refused(spark):
    with pytest.raises(ValueError):
        pack_pieces(spark.sql("select 1 as id, 600L as length"), 512)

