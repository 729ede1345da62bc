"""Ordered lines against invoice lines: greedy one-to-one match and classification.

Within one receiving the ordered lines are served in position order; each takes the best still free
invoice line (highest similarity, lowest position on ties) when the similarity reaches 0.25.

Two physical plans give the same rows:

* receivings of ordinary size: both sides are gathered per receiving (the size was checked before) and
  folded inside the row. One shuffle of both sides on the receiving id, which carries no normalized names or tokens; no
  pair rows ever leave a task;
* oversized receivings: the same assignment computed as deferred acceptance over distributed tables,
  keyed by receiving and name, token or text piece, so that one receiving spreads over the cluster (``crowded.py``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.functions.similarity import token_jaccard
from goodsledger.functions.text import let, name_tokens, normalize_product_name

# Thresholds and tolerances of the match.
REPLACEMENT_THRESHOLD = 0.25
MATCH_THRESHOLD = 0.55
QUANTITY_TOLERANCE = 0.0001
PRICE_TOLERANCE = 0.01

# Default comments.
COMMENT_MISSING = "Товар из заявки не найден в накладной"
COMMENT_EXTRA = "Позиция есть в накладной, но отсутствует в заявке"
COMMENT_CROSSED_OUT = "Строка отмечена как зачеркнутая"
COMMENT_REPLACEMENT = "Возможная замена товара"
COMMENT_QUANTITY = "Количество отличается от заявки"
COMMENT_PRICE = "Цена отличается от заявки"

# Lines one side of a receiving may have before the distributed plan takes over.
FOLD_LIMIT = 400

LINE_FIELDS = ("item_pos", "name", "quantity", "unit", "price", "crossed_out", "comment")
RESULT_COLUMNS = (
    "receiving_id", "item_pos", "order_pos", "invoice_pos", "score", "item_name_from_order",
    "item_name_from_invoice", "ordered_quantity", "received_quantity", "unit", "ordered_price",
    "invoice_price", "status", "comment",
)


def _lines(lines: DataFrame) -> DataFrame:
    have = set(lines.columns)
    return lines.select(
        "receiving_id",
        F.col("item_pos").cast("long").alias("item_pos"),
        "name",
        F.col("quantity").cast("double").alias("quantity"),
        (F.col("unit") if "unit" in have else F.lit("шт")).alias("unit"),
        F.col("price").cast("double").alias("price"),
        (F.col("crossed_out") if "crossed_out" in have else F.lit(False)).alias("crossed_out"),
        (F.col("comment") if "comment" in have else F.lit(None).cast("string")).alias("comment"),
    )


def oversized_receivings(orders: DataFrame, invoices: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Receivings with more lines on a side than one task should gather. Reads the key column only."""
    sides = [side.groupBy("receiving_id").count() for side in (orders, invoices)]
    return sides[0].unionByName(sides[1]).where(F.col("count") > fold_limit).select("receiving_id").distinct()


def match_lines(
    order_lines: DataFrame, invoice_lines: DataFrame, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Full reconciliation: matched rows, missing ordered lines and extra invoice lines.

    ``order_lines(receiving_id, item_pos, name, quantity, unit?, price)`` and
    ``invoice_lines(…, crossed_out?, comment?)``. ``item_pos`` of the result keeps the reading order:
    ordered lines first, then the extras.
    """
    oversized = oversized_receivings(order_lines, invoice_lines, fold_limit)
    if oversized.isEmpty():
        return match_gathered(order_lines, invoice_lines)

    from goodsledger.operators.crowded import match_crowded

    def split(lines: DataFrame, how: str) -> DataFrame:
        return lines.join(oversized, "receiving_id", how)

    ordinary = match_gathered(split(order_lines, "left_anti"), split(invoice_lines, "left_anti"))
    crowded = match_crowded(split(order_lines, "left_semi"), split(invoice_lines, "left_semi"))
    return ordinary.unionByName(crowded)


def match_gathered(order_lines: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """Match of receivings whose sides fit a task (see ``oversized_receivings``)."""

    def side(lines: DataFrame, name: str, other: str) -> DataFrame:
        line = F.struct(*LINE_FIELDS)
        # lines without a receiving stay apart by side
        apart = F.when(F.col("receiving_id").isNull(), F.lit(name)).alias("apart")
        return _lines(lines).select("receiving_id", apart, line.alias(name), F.lit(None).alias(other))

    both = side(order_lines, "order", "invoice").unionByName(side(invoice_lines, "invoice", "order"))
    gathered = both.groupBy("receiving_id", "apart").agg(
        F.sort_array(F.collect_list("order")).alias("orders"), F.sort_array(F.collect_list("invoice")).alias("invoices")
    )
    pairs = gathered.withColumns({"order_names": _names(F.col("orders")), "invoice_names": _names(F.col("invoices"))}).withColumn(
        "links", _greedy_links(F.col("order_names"), F.col("invoice_names"))
    )

    matched_orders = F.transform("links", lambda link: link["o"])
    matched_invoices = F.transform("links", lambda link: link["i"])
    rows = F.concat(
        F.transform(
            "links",
            lambda link: F.struct(
                F.get("orders", link["o"]).alias("order"),
                F.get("invoices", link["i"]).alias("invoice"),
                link["score"].alias("score"),
            ),
        ),
        F.transform(
            F.filter("orders", lambda o, n: ~F.array_contains(matched_orders, n)),
            lambda o: F.struct(o.alias("order"), F.lit(None).alias("invoice"), F.lit(None).alias("score")),
        ),
        F.transform(
            F.filter("invoices", lambda i, n: ~F.array_contains(matched_invoices, n)),
            lambda i: F.struct(F.lit(None).alias("order"), i.alias("invoice"), F.lit(None).alias("score")),
        ),
    )
    last_order = F.coalesce(F.element_at(F.transform("orders", lambda o: o["item_pos"]), -1), F.lit(0))
    exploded = pairs.select(
        "receiving_id",
        F.when(F.size("orders") > 0, last_order).otherwise(F.lit(0)).alias("last_order_pos"),
        F.inline_outer(rows),
    ).where(F.col("order").isNotNull() | F.col("invoice").isNotNull())
    return classify(exploded)


def _names(lines: Column) -> Column:
    """Normalized names of lines with their distinct tokens, and these in order as one text."""
    return F.transform(
        lines,
        lambda line: let(
            normalize_product_name(line["name"]),
            lambda norm: let(
                name_tokens(norm),
                lambda tokens: F.struct(
                    norm.alias("norm"), tokens.alias("tokens"), F.array_join(F.sort_array(tokens), " ").alias("bag")
                ),
            ),
        ),
    )


def _greedy_links(orders: Column, invoices: Column) -> Column:
    """Accepted (order index, invoice index, score) links, folded over the ordered lines.

    A free invoice line of similarity 1 (one text inside the other, or the same tokens) cannot be surpassed, so
    shares of tokens are worked out only for ordered lines that have none.
    """
    start = F.expr("cast(array() as array<struct<o:int,i:int,score:double>>)")

    def best(links: Column, order: Column) -> Column:
        def free(n: Column) -> Column:
            return ~F.exists(links, lambda link: link["i"] == n)

        def full(line: Column) -> Column:
            inside = line["norm"].contains(order["norm"]) | order["norm"].contains(line["norm"])
            return (order["norm"] != "") & (line["norm"] != "") & (inside | (line["bag"] == order["bag"]))

        def first(wanted, neg) -> Column:
            return F.array_min(
                F.transform(
                    invoices, lambda line, n: F.when(wanted(line) & free(n), F.struct(neg(line).alias("neg"), n.alias("i")))
                )
            )

        return F.coalesce(
            first(full, lambda line: F.lit(-1.0)),
            first(lambda line: F.lit(True), lambda line: -token_jaccard(order["tokens"], line["tokens"])),
        )

    indexed = F.transform(orders, lambda line, n: F.struct(n.alias("n"), line.alias("line")))

    def step(links: Column, item: Column) -> Column:
        accepted = F.filter(
            F.array(best(links, item["line"])), lambda b: b.isNotNull() & (-b["neg"] >= REPLACEMENT_THRESHOLD)
        )
        return F.concat(
            links,
            F.transform(
                accepted,
                lambda b: F.struct(item["n"].alias("o"), b["i"].alias("i"), (-b["neg"]).alias("score")),
            ),
        )

    return F.aggregate(indexed, start, step)


def classify(rows: DataFrame) -> DataFrame:
    """Status and comment of (order?, invoice?, score?) rows; either side may be absent."""
    order, invoice = F.col("order"), F.col("invoice")
    has_order, has_invoice = order.isNotNull(), invoice.isNotNull()
    crossed = F.coalesce(invoice["crossed_out"], F.lit(False))
    said = F.nullif(invoice["comment"], F.lit(""))
    quantity_off = F.abs(order["quantity"] - invoice["quantity"]) > QUANTITY_TOLERANCE
    price_off = F.abs(order["price"] - invoice["price"]) > PRICE_TOLERANCE

    cases = [
        (~has_invoice, "missing", F.lit(COMMENT_MISSING)),
        (~has_order & crossed, "crossed_out", F.coalesce(said, F.lit(COMMENT_EXTRA))),
        (~has_order, "extra", F.coalesce(said, F.lit(COMMENT_EXTRA))),
        (crossed, "crossed_out", F.coalesce(said, F.lit(COMMENT_CROSSED_OUT))),
        (F.col("score") < MATCH_THRESHOLD, "replacement_candidate", F.coalesce(said, F.lit(COMMENT_REPLACEMENT))),
        (quantity_off, "quantity_mismatch", F.coalesce(said, F.lit(COMMENT_QUANTITY))),
        (price_off, "price_mismatch", F.coalesce(said, F.lit(COMMENT_PRICE))),
    ]
    status = reduce(lambda acc, case: acc.when(case[0], case[1]), cases[1:], F.when(cases[0][0], cases[0][1]))
    comment = reduce(lambda acc, case: acc.when(case[0], case[2]), cases[1:], F.when(cases[0][0], cases[0][2]))

    zero = F.lit(0.0)
    return rows.select(
        "receiving_id",
        F.when(has_order, order["item_pos"])
        .otherwise(F.col("last_order_pos") + invoice["item_pos"])
        .alias("item_pos"),
        order["item_pos"].alias("order_pos"),
        invoice["item_pos"].alias("invoice_pos"),
        F.col("score").cast("double").alias("score"),
        order["name"].alias("item_name_from_order"),
        invoice["name"].alias("item_name_from_invoice"),
        F.coalesce(order["quantity"], zero).alias("ordered_quantity"),
        F.coalesce(invoice["quantity"], zero).alias("received_quantity"),
        F.coalesce(F.nullif(invoice["unit"], F.lit("")), order["unit"]).alias("unit"),
        F.coalesce(order["price"], zero).alias("ordered_price"),
        F.coalesce(invoice["price"], zero).alias("invoice_price"),
        status.otherwise("matched").alias("status"),
        comment.otherwise(invoice["comment"]).alias("comment"),
    )


def unmatched_orders(items: DataFrame) -> DataFrame:
    """Ordered lines the invoice does not have."""
    return items.where(F.col("status") == "missing")


def unmatched_invoices(items: DataFrame) -> DataFrame:
    """Invoice lines the order does not have: extra, or crossed out on paper."""
    return items.where(F.col("order_pos").isNull())
