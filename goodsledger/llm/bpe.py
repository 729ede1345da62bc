"""Byte-level BPE by a global shuffle of distinct words.

Documents are taken in blocks of bounded size. Within a block each pre-token becomes the number of its word, so
positions are kept as packed lists of small numbers, and each distinct word of the block becomes one row. Both are
stored once, bucketed by block. The word rows of all blocks meet by word, where each distinct word is encoded
once; the ids go back, packed by block, and join the block's positions where those lie. Decoding joins every id
to the token-byte table, which is as large as the vocabulary whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from goodsledger.llm import bpe_tables
from goodsledger.llm.common import ID, TEXT, id_type, in_arrow, intake, store_bucketed

#: Bytes of text that a block holds; a longer document is a block of its own.
BLOCK_BYTES = 24 << 20
#: Numbers that are packed at a time, and word rows whose ids are packed together.
AT_ONCE, WORD_ROWS = 200_000, 100_000
#: Documents that leave a task together.
DOCUMENTS = 512


class Block:
    """Pre-tokens of some documents as numbers of their distinct words."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.keys: list = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, key, text: bytes, split) -> None:
        self.size += len(text)
        numbers = self.numbers
        found = [numbers.setdefault(word, len(numbers)) for word in split.findall(text.decode())]
        self.keys.append(key)
        self.found.append(np.array(found, dtype=np.uint32))

    def ranked(self) -> tuple[list[str], np.ndarray]:
        """The words by falling frequency, equal ones in order of the word; each number's place in that list."""
        words = sorted(self.numbers)
        first = np.fromiter((self.numbers[w] for w in words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        for some in self.slices():
            counts += np.bincount(np.concatenate(some), minlength=len(words))
        order = np.argsort(-counts[first], kind="stable")
        place = np.empty(len(words), np.uint32)
        place[first[order]] = np.arange(len(words), dtype=np.uint32)
        return [words[i] for i in order], place

    def positions(self, place: np.ndarray) -> list[bytes]:
        """Per document the packed places of its words in order."""
        out = []
        for some in self.slices():
            data, ends = packed_numbers(place[np.concatenate(some)])
            cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, some)])]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def slices(self):
        """The documents' numbers, some documents at a time: about ``AT_ONCE`` numbers, at least one document."""
        start, size = 0, 0
        for i, found in enumerate(self.found):
            size += len(found)
            if size >= AT_ONCE or i + 1 == len(self.found):
                yield self.found[start : i + 1]
                start, size = i + 1, 0


def blocks(batches, block_bytes: int):
    """(number, block) of one task."""
    task, n, split = TaskContext.get().partitionId(), 0, bpe_tables.splitter()
    block = Block()
    for batch in batches:
        for key, value in zip(batch.column(ID), batch.column(TEXT).cast(pa.binary()), strict=True):
            text = value.as_py()
            if block.keys and block.size + len(text) > block_bytes:
                yield task << 32 | n, block
                block, n = Block(), n + 1
            block.add(key.as_py(), text, split)
    if block.keys:
        yield task << 32 | n, block


def packed_numbers(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, the highest set where more follow; and where each number ends."""
    sizes = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[ends[has] - sizes[has] + k] = (numbers[has] >> np.uint32(7 * k)).astype(np.uint8) & 127 | more
    return out.tobytes(), ends


def unpacked_numbers(data: bytes) -> np.ndarray:
    """The numbers of ``packed_numbers``."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1])
    numbers = np.zeros(len(ends), np.int64)
    for k in range(5):
        at = starts + k
        has = at <= ends
        numbers[has] |= (raw[at[has]] & 127).astype(np.int64) << 7 * k
    return numbers


def block_batches(found, id_arrow):
    """The rows of each block. Nothing of a block is held while the next one is read."""
    for at, block in found:
        words, place = block.ranked()
        yield batch_of(at, len(words), id_arrow, number=np.arange(len(words), dtype=np.int32), word=words)
        del words
        yield batch_of(at, len(block.keys), id_arrow, key=block.keys, positions=block.positions(place))
        del block, place


def tokenized(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Stored rows of two kinds: (block, number, word), the commonest word first, and (block, _id, positions)."""
    id_arrow = to_arrow_type(rows.schema[ID].dataType)

    def run(batches):
        yield from block_batches(blocks(batches, block_bytes), id_arrow)

    schema = f"block long, number int, word string, {ID} {id_type(rows)}, positions binary"
    return store_bucketed(in_arrow(rows, run, schema), "block", "words")


def batch_of(block: int, n: int, id_arrow, number=None, word=None, key=None, positions=None) -> pa.RecordBatch:
    kinds = {"number": (number, pa.int32()), "word": (word, pa.string()), ID: (key, id_arrow), "positions": (positions, pa.binary())}
    columns = {name: pa.nulls(n, kind) if values is None else pa.array(values, kind) for name, (values, kind) in kinds.items()}
    return pa.RecordBatch.from_pydict({"block": pa.array(np.full(n, block, np.int64))} | columns)


def width(ranks: bytes) -> str:
    """Smallest unsigned type for the ids between the two shuffles."""
    return "<u2" if max(bpe_tables.token_bytes(ranks).values(), default=0) < 1 << 16 else "<u4"


def encoded_words(words: DataFrame, ranks, kind: str) -> DataFrame:
    """(block, numbers, sizes, ids): words of all blocks side by side, each distinct one encoded once, packed by block.

    The ids of every ``WORD_ROWS`` rows are packed at once, so a block may get several rows from one task.
    """

    def packed(at, number, made):
        at, number = np.concatenate(at), np.concatenate(number)
        order = np.lexsort((number, at))
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            ids = [made[i] for i in part]
            steps = np.diff(number[part], prepend=0).astype(np.uint32)
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // np.dtype(kind).itemsize
            rows.append({"block": int(at[part[0]]), "numbers": packed_numbers(steps)[0], "sizes": packed_numbers(sizes)[0], "ids": b"".join(ids)})
        return pa.RecordBatch.from_pylist(rows)

    def run(batches):
        coder, last, codes = bpe_tables.encoding(ranks.value), None, b""
        at, number, made = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("word").dictionary_encode()
            known = []
            for word in found.dictionary.to_pylist():
                if word != last:
                    last, codes = word, np.array(bpe_tables.encode_word(coder, word), dtype=kind).tobytes()
                known.append(codes)
            made += map(known.__getitem__, found.indices.to_pylist())
            at.append(batch.column("block").to_numpy())
            number.append(batch.column("number").to_numpy().astype(np.int64))
            if len(made) >= WORD_ROWS:
                yield packed(at, number, made)
                at, number, made = [], [], []
        if made:
            yield packed(at, number, made)

    together = words.repartition("word").sortWithinPartitions("word")
    return in_arrow(together, run, "block long, numbers binary, sizes binary, ids binary")


def reassemble(positions: pa.Table, words: pa.Table, kind: str) -> pa.Table:
    """Ids of the documents of one block."""
    numbers = [np.cumsum(unpacked_numbers(n)) for n in words["numbers"].to_pylist()]
    sizes = [unpacked_numbers(s) for s in words["sizes"].to_pylist()]
    flat = np.frombuffer(b"".join(words["ids"].to_pylist()), dtype=kind)
    place = np.concatenate([np.zeros(0, np.int64), *numbers])
    each = np.concatenate([np.zeros(0, np.int64), *sizes])
    size_of, start_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    size_of[place], start_of[place] = each, np.cumsum(each) - each
    out = []
    for value in positions["positions"]:
        at = unpacked_numbers(value.as_py())
        counts = size_of[at]
        shift = np.repeat(start_of[at] - (np.cumsum(counts) - counts), counts)
        out.append(flat[shift + np.arange(len(shift))].astype("<u4").tobytes())
    return pa.table({ID: positions[ID], "ids": pa.array(out, pa.binary())})


def _by_block(docs: DataFrame, id_col: str, text_col: str, ranks: str | None, block_bytes: int, finish, more: str) -> DataFrame:
    """Rows (_id, ids) of the blocks; ``finish(batch, rank table)`` adds the columns ``more`` where the ids are made."""
    rows = intake(docs, id_col, text_col)
    table = bpe_tables.rank_file(ranks or bpe_tables.ranks_path())
    kind = width(table)
    found = tokenized(rows, block_bytes)
    words = found.where(F.col("number").isNotNull()).select("block", "number", "word")
    sent = rows.sparkSession.sparkContext.broadcast(table)
    coded = encoded_words(words, sent, kind)
    positions = found.where(F.col("number").isNull()).select("block", ID, "positions")
    blocked = positions.groupBy("block").cogroup(coded.groupBy("block"))

    def run(left, right):
        made = reassemble(left, right, kind)
        # a block without documents has no batches; finish then sees an empty one
        parts = made.to_batches(DOCUMENTS) or [pa.RecordBatch.from_pylist([], made.schema)]
        return pa.Table.from_batches(parts if finish is None else [finish(part, sent.value) for part in parts])

    return blocked.applyInArrow(run, f"{ID} {id_type(rows)}, ids binary{more}")


def encode(docs: DataFrame, id_col="doc_id", text_col="text", *, ranks: str | None = None, block_bytes=BLOCK_BYTES) -> DataFrame:
    """(_id, ids) per row; ids are little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Null and repeated ids stay as they are. An empty table gives no rows.
    """
    return _by_block(docs, id_col, text_col, ranks, block_bytes, None, "")


def with_decoded(batch: pa.RecordBatch, ranks: bytes) -> pa.RecordBatch:
    """A batch (_id, ids) beside the bytes of its ids."""
    table = bpe_tables.byte_table(ranks)
    decoded = []
    for ids in batch.column("ids").to_pylist():
        found = table.take(pa.array(np.frombuffer(ids or b"", dtype="<u4")))
        decoded.append(joined(found))
    kept = {name: batch.column(name) for name in (ID, "ids")}
    return pa.RecordBatch.from_pydict(kept | {"decoded": pa.array(decoded, pa.binary())})


def decode(coded: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """(_id, ids, decoded) of rows (_id, ids): the bytes of the ids, joined from the token-byte table."""
    sent = coded.sparkSession.sparkContext.broadcast(bpe_tables.rank_file(ranks or bpe_tables.ranks_path()))

    def run(batches):
        for batch in batches:
            yield with_decoded(batch, sent.value)

    return in_arrow(coded.select(ID, "ids"), run, f"{ID} {id_type(coded)}, ids binary, decoded binary")


def joined(found: pa.LargeBinaryArray) -> bytes:
    """The values of a binary array one after the other: its data buffer between the first and last offset."""
    if not len(found):
        return b""
    offsets = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1]
    return found.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()


def round_trip(docs: DataFrame, id_col="doc_id", text_col="text", *, ranks: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256.

    The ids are decoded where they are put together, so that a task of that stage has one Python worker, not two.
    """
    both = _by_block(docs, id_col, text_col, ranks, BLOCK_BYTES, with_decoded, ", decoded binary")
    return both.select(
        F.col(ID).alias(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
