"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are integers from 1 to the capacity, so an instance of any number of documents is its histogram: at
most ``capacity`` counts. The plan of the packing is made on the histogram alone, with multiplicities
(``plan_packing``); the documents never leave the executors. They are ranked within their length by salted,
pre-counted groups, and a bounded slot table turns (length, rank) into (sequence, offset).

* Dominance: a set of lengths that contains j dominates all other feasible sets with j when each of those
  can be exchanged for it without using more sequences. Such sets are fixed for as many copies as the
  argument holds, and leave the instance: exact complements; the largest partner where at most one fits, or
  where no two others fill more than it; a triple where its members cover those of all others.
* The remainder, in order of falling length, goes best fit: to the open sequence with the least room left
  that holds it. Equal lengths fill equal sequences in one step.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goodsledger.llm import bpe_tables
from goodsledger.llm.common import ID, id_type, in_arrow, intake, per_batch, store

#: Rows of one length that one task ranks.
ROWS_PER_SALT = 100_000


class Stock:
    """Counts by length, with the lengths still present in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.count)

    def take(self, length: int, copies: int) -> None:
        self.count[length] -= copies
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def largest(self, room: int, used: Counter) -> int:
        """The largest length up to ``room`` of which a copy is left beside those in ``used``; 0 if none."""
        at = bisect.bisect_right(self.lengths, room)
        while at:
            at -= 1
            length = self.lengths[at]
            if self.count[length] > used[length]:
                return length
        return 0

    def smallest(self, n: int, used: Counter, above: int = 0) -> list[int]:
        """The ``n`` smallest copies over ``above`` beside those in ``used``; fewer if there are no more."""
        found: list[int] = []
        for length in self.lengths[bisect.bisect_right(self.lengths, above) :]:
            found += [length] * min(n - len(found), self.count[length] - used[length])
            if len(found) == n:
                break
        return found

    def fullest_pair(self, room: int, used: Counter) -> int:
        """The most that two copies beside those in ``used`` fill of ``room``; 0 if no two fit."""
        best = 0
        for length in self.lengths:
            if 2 * length > room:
                break
            if self.count[length] > used[length]:
                other = self.largest(room - length, used + Counter([length]))
                if other:
                    best = max(best, length + other)
        return best


def dominating_set(stock: Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every other feasible set with j, or None where none is proven."""
    room, used = capacity - j, Counter([j])
    partner = stock.largest(room, used)
    if not partner:
        return (j,)
    if partner == room:
        return j, partner
    small = stock.smallest(3, used)
    if len(small) < 2 or small[0] + small[1] > room:
        return j, partner
    if len(small) == 3 and sum(small) <= room:
        return None
    if stock.fullest_pair(room, used) <= partner:
        return j, partner
    third = stock.largest(room - partner, used + Counter([partner]))
    if third:
        above = stock.smallest(2, used, above=third)
        if len(above) < 2 or sum(above) > room:
            return j, partner, third
    return None


def reduce_by_dominance(stock: Stock, capacity: int) -> list[tuple[int, tuple]]:
    """Fix dominating sets until no more is proven; the stock keeps the remainder."""
    fixed = []
    progress = True
    while progress:
        progress = False
        for j in reversed(list(stock.lengths)):
            while j in stock.count and (chosen := dominating_set(stock, j, capacity)):
                need = Counter(chosen)
                copies = min(stock.count[length] // n for length, n in need.items())
                if chosen == (j,) and 2 * j <= capacity:
                    copies = 1  # a second copy would have been a partner
                for length, n in need.items():
                    stock.take(length, n * copies)
                fixed.append((copies, tuple(sorted(need.items(), reverse=True))))
                progress = True
    return fixed


def best_fit(stock: Stock, capacity: int) -> list[tuple[int, tuple]]:
    """Best fit in order of falling length. Equal sequences are kept as one group (number, contents)."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, tuple]]] = {}

    def put(room: int, number: int, items: tuple) -> None:
        if number:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((number, items))

    for length in reversed(stock.lengths):
        left = stock.count[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                number, items = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, items, number = capacity, (), ceil(left / (capacity // length))
            each = room // length
            full = min(number, left // each)
            left -= full * each
            put(room - each * length, full, (*items, (length, each)))
            number -= full
            if number and left:
                put(room - left * length, 1, (*items, (length, left)))
                number, left = number - 1, 0
            put(room, number, items)
    return [group for of_room in groups.values() for group in of_room]


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Groups (number of sequences, ((length, copies), ...)) that hold every length of the histogram."""
    stock = Stock(counts)
    fixed = reduce_by_dominance(stock, capacity)
    return fixed + best_fit(stock, capacity)


def slot_arrays(plan: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """Which ranks of a length go where, in order of (length, first rank). As many rows as the plan has items."""
    rows, ranked, base = [], Counter(), 0
    for number, items in plan:
        offset = 0
        for length, copies in items:
            rows.append((length, ranked[length], base, copies, offset))
            ranked[length] += number * copies
            offset += length * copies
        base += number
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "copies", "offset"), table.T, strict=True))


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter."""
    starts = range(tokens % capacity, tokens, capacity) if tokens % capacity else range(0, tokens, capacity)
    head = [(0, tokens % capacity)] if tokens % capacity else []
    return head + [(start, capacity) for start in starts]


def token_pieces(docs: DataFrame, id_col="doc_id", text_col="text", *, ranks=None, tokenizer=None, capacity=2048, end_id=0) -> DataFrame:
    """Pieces (_id, piece, start, length, ids_crc32) of the documents' token sequences, each closed by ``end_id``.

    Null and empty texts have one piece, the end id. Marks that the ``tokenizer`` file adds to its vocabulary are
    tokens where a text holds them. A text longer than the capacity is cut.
    """
    rows = intake(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(bpe_tables.rank_file(ranks or bpe_tables.ranks_path()))
    marks = bpe_tables.added_tokens(tokenizer)

    def build(ids: pa.Array, texts: list[bytes]) -> dict:
        coder = bpe_tables.encoding(sent.value)
        at, out = [], {name: [] for name in ("piece", "start", "length", "ids_crc32")}
        for row, text in enumerate(texts):
            codes = np.array([*bpe_tables.encode_marked(coder, text.decode(), marks), end_id], dtype="<u4")
            for piece, (start, length) in enumerate(cut(len(codes), capacity)):
                at.append(row)
                out["piece"].append(piece)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(codes[start : start + length].tobytes()))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return {ID: ids.take(pa.array(at, pa.int64()))} | {
            name: pa.array(values, kind) for (name, values), kind in zip(out.items(), types, strict=True)
        }

    schema = f"{ID} {id_type(rows)}, piece int, start long, length long, ids_crc32 long"
    return in_arrow(rows, lambda batches: per_batch(batches, build), schema)


def rank_in_length(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Number the rows of each length from 0. ``pieces`` must be stored, as its row numbers decide the order.

    A length is split by row number into groups of bounded size; groups are counted, their offsets summed
    over the few groups of a length, and rows numbered within their group.
    """
    salts = max(16, ceil(max(counts.values(), default=0) / ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank_before")
    )
    within = Window.partitionBy("length", "salt").orderBy("row")
    return (
        salted.withColumn("rank", F.row_number().over(within).cast("long") - 1)
        .join(offsets, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("rank_before"))
        .drop("salt", "rank_before")
    )


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every row of ``pieces`` (any columns, ``length`` from 1 to the capacity) a sequence and an offset.

    No rows: no rows. Equal rows are separate pieces. Adds ``sequence_id`` (from 0, without gaps) and ``offset``.
    """
    stored = store(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}  # capacity rows at most
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    slots = slot_arrays(plan_packing(counts, capacity))
    keys = slots["length"] << 50 | slots["first"]
    ranked = rank_in_length(stored, counts)

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 50 | rank, side="right") - 1
            nth = rank - slots["first"][at]
            sequence = slots["sequence"][at] + nth // slots["copies"][at]
            offset = slots["offset"][at] + nth % slots["copies"][at] * length
            kept = {n: batch.column(n) for n in batch.schema.names if n not in ("row", "rank")}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": sequence, "offset": offset})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("row", "rank")]
    return in_arrow(ranked, place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", *, ranks=None, capacity=2048, end_id=0) -> DataFrame:
    """Pack whole documents: one row per piece with its place.

    Null ids stay null, repeated rows are packed each, further columns are ignored, an empty table gives none.
    """
    pieces = token_pieces(docs, id_col, text_col, ranks=ranks, capacity=capacity, end_id=end_id)
    return pack_pieces(pieces, capacity).withColumnRenamed(ID, id_col)

