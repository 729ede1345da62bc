"""Exact duplicates by content-defined chunk recipes.

Each text is cut where its content says so: behind a position whose last 8 bytes hash to a given remainder,
between a smallest and a largest chunk size. Equal texts have equal cuts, and long texts share the chunks of
passages they share. A chunk's bytes move once, after equal ones have met on the map side, to verify that its
digest stands for one content. If some digest does not, all chunks are digested anew under the next seed, so
the identifiers in use are always verified. Texts are then compared by their ordered identifier lists alone.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goodsledger.llm.common import ID, TEXT, byte_texts, id_type, in_arrow, intake, keep_rows, store

SMALLEST, LARGEST, MASK = 2048, 32768, 4095
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(text: bytes, smallest: int = SMALLEST, largest: int = LARGEST, mask: int = MASK) -> list[int]:
    """Ends of the chunks; none for an empty text. Depends on nothing but the text and the settings."""
    if not text:
        return []
    ends, at = [], 0
    if len(text) > smallest:
        data = np.frombuffer(text, dtype=np.uint8)
        windows = np.ndarray((len(text) - 7,), dtype="<u8", buffer=data, strides=(1,))
        marks = np.flatnonzero((windows * MULTIPLIER) >> np.uint64(40) & np.uint64(mask) == 0) + 8
        while len(text) - at > smallest:
            nth = np.searchsorted(marks, at + smallest)
            end = int(marks[nth]) if nth < len(marks) else len(text)
            at = min(end, at + largest)
            ends.append(at)
    if at < len(text):
        ends.append(len(text))
    return ends


def chunks_of(text: bytes) -> list[bytes]:
    ends = chunk_ends(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)


def recipes(rows: DataFrame, digest_of, seed: int) -> DataFrame:
    """(_id, text_sha256, recipe): the digests of each row's chunks in order; an empty list for an empty text."""

    def run(batches):
        for batch in batches:
            found = [[digest_of(chunk, seed) for chunk in chunks_of(text)] for text in byte_texts(batch)]
            columns = {name: batch.column(name) for name in (ID, "text_sha256")}
            yield pa.RecordBatch.from_pydict(columns | {"recipe": pa.array(found, pa.list_(pa.binary()))})

    hashed = rows.withColumn("text_sha256", F.sha2(TEXT, 256))
    return in_arrow(hashed, run, f"{ID} {id_type(rows)}, text_sha256 string, recipe array<binary>")


def verified(rows: DataFrame, digest_of, seed: int) -> bool:
    """Whether every digest stands for one chunk content over all rows."""

    def run(batches):
        for batch in batches:
            found = list({chunk for text in byte_texts(batch) for chunk in chunks_of(text)})
            digests = pa.array([digest_of(chunk, seed) for chunk in found], pa.binary())
            yield pa.RecordBatch.from_pydict({"digest": digests, "content": pa.array(found, pa.binary())})

    contents = in_arrow(rows.select(TEXT), run, "digest binary, content binary").distinct()
    return contents.groupBy("digest").count().where("count > 1").isEmpty()


def identified(docs: DataFrame, id_col: str, text_col: str, digest_of=digest) -> DataFrame:
    """Stored (row, _id, text_sha256, recipe), one per row; equal recipes mean equal texts."""
    rows = intake(docs, id_col, text_col)
    seed = next(seed for seed in count() if verified(rows, digest_of, seed))
    return store(recipes(rows, digest_of, seed).withColumn("row", F.monotonically_increasing_id()), "recipes")


def exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", *, digest_of=digest) -> DataFrame:
    """Per row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    A null text is empty, and empty texts are equal. Null ids come last; a group of null ids alone has no
    keep_id, and one of its rows stays. Of repeated rows one stays. An empty table gives no rows.
    """
    rows = identified(docs, id_col, text_col, digest_of)
    stays = F.max(F.struct(F.col(ID).alias("keep_id"), (-F.col("row")).alias("nth"))).alias("stays")
    groups = store(rows.groupBy("recipe").agg(F.count("*").alias("group_size"), stays), "text-groups")
    return rows.join(groups, "recipe").select(
        F.col(ID).alias(id_col),
        F.col("stays.keep_id").alias("keep_id"),
        "group_size",
        (F.col("stays.nth") == -F.col("row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", *, digest_of=digest) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows = identified(docs, id_col, text_col, digest_of)
    named = rows.groupBy("recipe", ID, F.col("text_sha256").alias("_sha")).agg(F.count("*").alias("copies"))
    kept = named.groupBy("recipe").agg(F.max_by(F.struct(ID, "_sha", "copies"), F.struct(ID)).alias("row"))
    return keep_rows(docs, id_col, text_col, kept.select("row.*"))
