"""Pairs of names within a receiving that can be similar, found through indexes instead of all pairs.

Two sides of ``(receiving_id, norm)``, distinct, meet on

* a rare token: names of n and m tokens that reach a Jaccard share must have one of their rarest in common, where
  how many count as rarest follows from n, m and the share;
* the rarest piece of the text that lies inside the other, as wide as ``WIDTHS`` allows: wide pieces have few
  candidates, and only the widths that inner texts ask for are offered.

Keys hold the receiving and a salt, so that a token or piece of very many names spreads over ``SALTS`` tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.functions.similarity import token_similarity
from goodsledger.functions.text import name_tokens

KEY = "receiving_id"
SALTS = 8
#: Widths of pieces; a text asks for pieces of the largest that does not exceed its length.
WIDTHS = (1, 2, 3, 4, 8, 16, 32, 64)


def needed_overlap(own: Column, other: Column, share: float) -> Column:
    """Shared tokens a pair of these sizes needs to reach the Jaccard ``share``."""
    return F.ceil((own + other) * (share / (1 + share)) - 1e-9)


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def _salt_of(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")


def sharing_tokens(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """``(receiving_id, left, right)`` of pairs with a common token among the rarest; may repeat a pair."""

    def tokens(side: DataFrame) -> DataFrame:
        held = name_tokens(F.col("norm"))
        return side.select(KEY, "norm", F.size(held).alias("n"), F.explode(held).alias("token"))

    frequency = tokens(left).unionByName(tokens(right)).groupBy(KEY, "token").agg(F.count(F.lit(1)).alias("f"))

    def sizes(side: DataFrame) -> DataFrame:
        return side.select(KEY, F.size(name_tokens(F.col("norm"))).alias("m")).distinct()

    def rarest(side: DataFrame, other_sizes: DataFrame, own: str, other: str) -> DataFrame:
        ranked = (
            tokens(side).join(frequency, [KEY, "token"])
            .groupBy(KEY, "norm", "n")
            .agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("all"))
            .select(KEY, "norm", "n", F.posexplode("all").alias("at", "t"))
        )
        need = needed_overlap(F.col("n"), F.col("m"), share)
        inside = (F.col("at") < F.col("n") - need + 1) & (need <= F.least("n", "m"))
        return ranked.join(other_sizes, KEY).where(inside).select(
            KEY, F.col("norm").alias(own), F.col("t.token").alias("token"), F.col("n").alias(f"{own}_n"), F.col("m").alias(f"{other}_n")
        )

    asked = rarest(left, sizes(right), "left", "right").withColumn("salt", _every_salt())
    offered = rarest(right, sizes(left), "right", "left").withColumn("salt", _salt_of("right"))
    return asked.join(offered, [KEY, "token", "left_n", "right_n", "salt"]).select(KEY, "left", "right")


def containing(inner: DataFrame, outer: DataFrame, inner_name: str = "left", outer_name: str = "right") -> DataFrame:
    """Pairs in which the text of ``inner`` lies inside that of ``outer``; empty inner texts have no pairs."""

    size = F.length("norm")

    def pieces(width: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(size - width + 1, F.lit(0))), lambda s: s > 0)
        # hashes are enough, as every pair is looked at
        return F.transform(starts, lambda s: F.xxhash64(F.substr(F.col("norm"), s, width)))

    inner = inner.where(F.col("norm") != "")
    widest = F.array_max(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w <= size))
    # at most as many numbers as there are widths
    used = inner.agg(F.collect_set(widest).alias("used")).scalar()
    offered = (
        outer.withColumn("used", used)
        .select(KEY, F.col("norm").alias(outer_name), F.explode(F.array_distinct(F.flatten(F.transform("used", pieces)))).alias("piece"))
    )
    frequency = offered.groupBy(KEY, "piece").agg(F.count(F.lit(1)).alias("f"))
    asked = (
        inner.withColumn("widest", widest)
        .select(KEY, F.col("norm").alias(inner_name), F.explode(F.array_distinct(pieces(F.col("widest")))).alias("piece"))
        .join(frequency, [KEY, "piece"])
        .groupBy(KEY, inner_name)
        .agg(F.min(F.struct("f", "piece")).alias("best"))
        .select(KEY, inner_name, F.col("best.piece").alias("piece"), _every_salt().alias("salt"))
    )
    pairs = asked.join(offered.withColumn("salt", _salt_of(outer_name)), [KEY, "piece", "salt"])
    return pairs.where(F.col(outer_name).contains(F.col(inner_name))).select(KEY, "left", "right")


def similar_names(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """``(receiving_id, left, right, score)`` of every pair whose similarity reaches ``share``; may repeat a pair."""
    pairs = reduce(
        DataFrame.unionByName,
        [sharing_tokens(left, right, share), containing(left, right), containing(right, left, "right", "left")],
    )
    score = token_similarity(F.col("left"), F.col("right"), name_tokens(F.col("left")), name_tokens(F.col("right")))
    return pairs.withColumn("score", score).where(F.col("score") >= share)
