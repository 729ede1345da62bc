"""Corpus pipeline: quality rules, exact and near duplicates, secrets masked, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of its input.
Stages but the last keep clean documents as they are. Copies of a text, and near copies, leave one row each;
secrets are masked in place, with ``n_chars`` brought up to date. The last stage returns one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goodsledger.llm import exact_dedup, packing, quality_rules, secrets, simhash
from goodsledger.llm.common import read, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a shingle similarity of 0.8 or more (five words) the row with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, reported secrets are masked."""
    return secrets.mask_secrets(docs, size_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("secret scans", secret_masks),
    ("best-fit packing", packed),
]
#: The stages hash words, grow models and pack greedily, which the checking SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each stage's result is written and reread as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
