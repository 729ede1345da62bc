"""Discrepancy totals and supplier control.

Receivings and items are aggregated separately and joined on the supplier, so a receiving counts once
however many lines it has. The items reach their supplier through one equi-join on the receiving id after
they were pre-aggregated per receiving: the shuffle carries one small row per receiving, not per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.operators.lifecycle import SUPPLIER_MISMATCH_MARKER
from goodsledger.schemas import ITEM_STATUSES, PROBLEM_STATUSES

SUPPLIER_ITEM_COUNTS = ("missing", "extra", "quantity_mismatch", "price_mismatch")


def _mismatch() -> Column:
    return F.coalesce(F.col("comment").contains(SUPPLIER_MISMATCH_MARKER), F.lit(False))


def discrepancy_totals(receivings: DataFrame, items: DataFrame) -> DataFrame:
    """``(counter, n)`` rows; counters that stay at zero are absent."""
    heads = receivings.agg(
        F.count(F.lit(1)).alias("receivings"),
        F.count_if(F.col("status") == "control_required").alias("control_required"),
        F.count_if(_mismatch()).alias("supplier_mismatch"),
    )
    lines = items.join(receivings.select(F.col("id").alias("receiving_id")), "receiving_id", "left_semi").agg(
        *[F.count_if(F.col("status") == status).alias(status) for status in ITEM_STATUSES],
        F.count_if(F.col("status").isin(*PROBLEM_STATUSES)).alias("problem_items"),
    )

    def tall(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "counter", "n")

    return tall(heads).unionByName(tall(lines)).where(F.col("n") > 0)


def supplier_statistics(receivings: DataFrame, items: DataFrame) -> DataFrame:
    """Counters per supplier with problem rate, risk score and control class."""
    per_receiving = items.groupBy(F.col("receiving_id").alias("id")).agg(
        F.count_if(F.col("status").isin(*PROBLEM_STATUSES)).alias("problem_items"),
        *[F.count_if(F.col("status") == status).alias(status) for status in SUPPLIER_ITEM_COUNTS],
    )
    heads = receivings.select(
        "id",
        "supplier",
        (F.col("status") == "control_required").cast("long").alias("control_required"),
        _mismatch().cast("long").alias("supplier_mismatch"),
    )
    counters = ("problem_items", *SUPPLIER_ITEM_COUNTS, "supplier_mismatch", "control_required")
    stats = (
        heads.join(per_receiving, "id", "left")
        .groupBy("supplier")
        .agg(
            F.count(F.lit(1)).alias("receivings"),
            *[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in counters],
        )
    )
    rate = F.bround((F.col("problem_items") / F.col("receivings")).cast("decimal(38,12)"), 2)
    risk = F.col("problem_items") + 2 * F.col("supplier_mismatch") + 2 * F.col("control_required")
    return (
        stats.withColumn("problem_rate", rate.cast("double"))
        .withColumn("risk_score", risk)
        .withColumn("control_status", control_class(F.col("risk_score"), F.col("supplier_mismatch")))
        .select(
            "supplier", "receivings", "problem_items", "problem_rate", *SUPPLIER_ITEM_COUNTS,
            "supplier_mismatch", "control_required", "risk_score", "control_status",
        )
    )


def control_class(risk: Column, mismatches: Column) -> Column:
    return (
        F.when((risk >= 5) | (mismatches > 0), "control_required").when(risk >= 2, "watch").otherwise("ok")
    )


def supplier_ranking(stats: DataFrame) -> DataFrame:
    """Riskiest suppliers first; names break ties."""
    return stats.orderBy(F.col("risk_score").desc(), F.col("supplier").asc())
