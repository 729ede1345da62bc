"""The line match for oversized receivings, as distributed rounds.

Serving ordered lines in position order, each with its best free invoice line, is the stable assignment in
which every invoice line prefers the lowest order position. It is reached by deferred acceptance in any order of
proposals, so whole blocks of lines can propose at once:

* lines with the same normalized name form a class; scores are computed once per pair of classes, and only for
  pairs that share a token that can matter or contain one another (``candidates.py``, never all pairs);
* classes with the same scored options (told by their number and two sums of hashes over them) propose as one, so
  lines that are equally similar to the same invoice lines settle together, however many names they have;
* per round the j-th free order line of a class proposes to the j-th best invoice line that its class may
  still get; an invoice line keeps the lowest position and releases the other.

All joins are keyed by receiving and name, token, text piece or position, so one receiving spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goodsledger.functions.text import normalize_product_name
from goodsledger.operators.candidates import similar_names
from goodsledger.operators.matching import LINE_FIELDS, REPLACEMENT_THRESHOLD, _lines, classify
from goodsledger.session import stored

# Positions per range when ranking inside a class; one range is one task's sort.
RANK_SPAN = 100_000


def class_scores(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """``(receiving_id, o_norm, i_norm, score)`` of every class pair that reaches the threshold."""
    sides = [side.select("receiving_id", "norm").distinct() for side in (orders, invoices)]
    pairs = similar_names(*sides, REPLACEMENT_THRESHOLD).distinct()
    return pairs.select("receiving_id", F.col("left").alias("o_norm"), F.col("right").alias("i_norm"), "score")


def option_classes(scores: DataFrame) -> DataFrame:
    """``(receiving_id, o_norm, kind)``: names with the same options have the same kind.

    The kind is made of the number of options and two independent sums of hashes, 128 bits in all, combined on
    the map side; no list of options is gathered.
    """
    def total(salt: str) -> Column:
        return F.sum(F.xxhash64(F.lit(salt), "i_norm", "score").cast("decimal(20,0)"))

    summed = scores.groupBy("receiving_id", "o_norm").agg(F.count(F.lit(1)).alias("n"), total("a").alias("a"), total("b").alias("b"))
    return summed.select("receiving_id", "o_norm", F.concat_ws(":", "n", "a", "b").alias("kind"))


def _ranked(rows: DataFrame, keys: list[str], order: list[Column], position: str, span: int) -> DataFrame:
    """Rank from 1 inside ``keys`` by ``order`` then ``position``, without sorting a whole key in one task.

    Rows are ranked inside position ranges and shifted by the sizes of the groups before.
    """
    names = [f"_k{n}" for n in range(len(order))]
    staged = rows.withColumns({n: c for n, c in zip(names, order)}).withColumn("_range", F.floor(F.col(position) / span))
    group = [*keys, *names, "_range"]
    inside = Window.partitionBy(*group).orderBy(position)
    before = Window.partitionBy(*keys).orderBy(*names, "_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))
    ).drop("_n")
    return (
        staged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, group)
        .withColumn("rank", F.col("_inside") + F.col("_before"))
        .drop(*names, "_range", "_inside", "_before")
    )


def match_crowded(order_lines: DataFrame, invoice_lines: DataFrame, span: int = RANK_SPAN) -> DataFrame:
    """Matched, missing and extra rows of oversized receivings, as ``match_lines`` returns them."""
    spark = order_lines.sparkSession
    # written by columns: a checkpoint holds whole rows as they are in memory, and is read with all of them
    orders, invoices = (
        stored(_lines(side).withColumn("norm", normalize_product_name("name")), "crowded_lines") for side in (order_lines, invoice_lines)
    )
    scores = stored(class_scores(orders, invoices), "crowded_scores")
    o_items = orders.select("receiving_id", F.col("norm").alias("o_norm"), F.col("item_pos").alias("o_pos"))
    i_items = invoices.select("receiving_id", F.col("norm").alias("i_norm"), F.col("item_pos").alias("i_pos"))
    kinds = option_classes(scores)
    able = o_items.join(kinds, ["receiving_id", "o_norm"])
    class_options = stored(
        scores.join(kinds, ["receiving_id", "o_norm"]).select("receiving_id", "kind", "i_norm", "score").distinct(),
        "crowded_options",
    )
    held = spark.createDataFrame([], "receiving_id long, i_pos long, o_pos long")
    cls = ["receiving_id", "kind"]
    while True:
        free = able.join(held, ["receiving_id", "o_pos"], "left_anti")
        fronts = free.groupBy(*cls).agg(F.min("o_pos").alias("front"), F.count(F.lit(1)).alias("waiting"))
        options = (
            fronts.join(class_options, cls)
            .join(i_items, ["receiving_id", "i_norm"])
            .join(held.withColumnRenamed("o_pos", "h_pos"), ["receiving_id", "i_pos"], "left")
            .where(F.col("h_pos").isNull() | (F.col("h_pos") > F.col("front")))
            .select(*cls, "i_pos", "h_pos", "waiting", (-F.col("score")).alias("neg"))
        )
        ranked_options = _ranked(options, cls, [F.col("neg")], "i_pos", span).where(F.col("rank") <= F.col("waiting"))
        proposals = stored(
            _ranked(free, cls, [], "o_pos", span)
            .join(ranked_options.select(*cls, "rank", "i_pos", "h_pos"), [*cls, "rank"])
            .where(F.col("h_pos").isNull() | (F.col("h_pos") > F.col("o_pos")))
            .select("receiving_id", "i_pos", "o_pos"),
            "crowded_proposals",
        )
        if proposals.isEmpty():
            break
        held = stored(
            held.unionByName(proposals).groupBy("receiving_id", "i_pos").agg(F.min("o_pos").alias("o_pos")), "crowded_held"
        )

    links = (
        held.join(o_items, ["receiving_id", "o_pos"])
        .join(i_items, ["receiving_id", "i_pos"])
        .join(scores, ["receiving_id", "o_norm", "i_norm"])
        .select("receiving_id", "o_pos", "i_pos", "score")
    )

    def packed(lines: DataFrame, name: str, pos: str) -> DataFrame:
        return lines.select("receiving_id", F.col("item_pos").alias(pos), F.struct(*LINE_FIELDS).alias(name))

    o_rows, i_rows = packed(orders, "order", "o_pos"), packed(invoices, "invoice", "i_pos")
    matched = (
        o_rows.join(links, ["receiving_id", "o_pos"], "left").join(i_rows, ["receiving_id", "i_pos"], "left")
        .select("receiving_id", "order", "invoice", "score")
    )
    extras = i_rows.join(links, ["receiving_id", "i_pos"], "left_anti").select(
        "receiving_id", F.lit(None).cast(o_rows.schema["order"].dataType).alias("order"), "invoice",
        F.lit(None).cast("double").alias("score"),
    )
    last = orders.groupBy("receiving_id").agg(F.max("item_pos").alias("last_order_pos"))
    rows = matched.unionByName(extras).join(last, "receiving_id", "left").withColumn(
        "last_order_pos", F.coalesce("last_order_pos", F.lit(0))
    )
    return classify(rows)
