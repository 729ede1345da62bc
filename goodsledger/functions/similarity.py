"""Name similarity measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goodsledger.functions.text import as_col, let, name_tokens, normalize_product_name


def token_jaccard(left_tokens: Column, right_tokens: Column) -> Column:
    """Jaccard share of two lists of distinct tokens."""
    both = F.size(left_tokens) + F.size(right_tokens)
    # shared / (both - shared), with the intersection evaluated once
    return let(
        F.size(F.array_intersect(left_tokens, right_tokens)),
        lambda shared: shared / F.greatest(both - shared, F.lit(1)),
    )


def token_similarity(left: Column, right: Column, left_tokens: Column, right_tokens: Column) -> Column:
    """Token-set Jaccard, lifted to 1.0 when one normalized text contains the other.

    Takes normalized texts with their distinct tokens, so callers tokenize each line once.
    """
    return (
        F.when((left == "") | (right == ""), F.lit(0.0))
        .when(left.contains(right) | right.contains(left), F.lit(1.0))
        .otherwise(token_jaccard(left_tokens, right_tokens))
    )


def normalized_similarity(left: Column, right: Column) -> Column:
    """Similarity of two texts that are normalized already."""
    return token_similarity(left, right, name_tokens(left), name_tokens(right))


def product_similarity(left: Column | str, right: Column | str) -> Column:
    return normalized_similarity(normalize_product_name(as_col(left)), normalize_product_name(as_col(right)))


def containment_similarity(left: Column, right: Column) -> Column:
    """Exact branches of the catalog measure: equality and containment, null where neither holds."""
    short = F.least(F.length(left), F.length(right))
    long = F.greatest(F.length(left), F.length(right))
    return (
        F.when((left == "") | (right == ""), F.lit(0.0))
        .when(left == right, F.lit(1.0))
        .when(left.contains(right) | right.contains(left), F.greatest(F.lit(0.75), short / long))
    )
