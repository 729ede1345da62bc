"""The match shuffles its lines once and runs once; its shortcuts leave the rows as they are."""

import random
import re

from pyspark.sql import functions as F

from goodsledger.functions.text import normalize_catalog_text, normalize_product_name
from goodsledger.operators.lifecycle import compare_invoices
from goodsledger.operators.matching import match_gathered

LINES = "receiving_id long, item_pos long, name string, quantity double, unit string, price double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_for_both_sides(spark):
    lines = spark.createDataFrame([(1, 1, "a b", 1.0, "шт", 1.0)], LINES)
    text = plan(match_gathered(lines, lines))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Join" not in text


def test_items_are_matched_once(spark):
    lines = spark.createDataFrame([(1, 1, "a b", 1.0, "шт", 1.0)], LINES)
    receivings = spark.createDataFrame([(1, "s", "open", None)], "id long, supplier string, status string, comment string")
    heads = spark.createDataFrame([(1, "n", "d", "s")], "receiving_id long, invoice_number string, invoice_date string, supplier_legal_name string")
    after, items, _ = compare_invoices(receivings, lines, heads, lines)
    assert "collect_list" not in plan(items) + plan(after)
    assert after.collect()[0].status == "matched_full"


def test_equal_tokens_before_contained_text(spark):
    """Similarity 1 is reached by equal tokens and by containment; the first free line of either kind is taken."""
    orders = spark.createDataFrame([(1, 1, "a b", 1.0, "шт", 1.0), (1, 2, "a b", 1.0, "шт", 1.0), (None, 1, "a b", 1.0, "шт", 1.0)], LINES)
    invoices = spark.createDataFrame(
        [(1, 1, "a c", 1.0, "шт", 1.0), (1, 2, "b a", 1.0, "шт", 1.0), (1, 3, "a b c", 1.0, "шт", 1.0), (None, 1, "a b", 1.0, "шт", 1.0)], LINES
    )
    got = {(r.receiving_id, r.order_pos, r.invoice_pos, r.score) for r in match_gathered(orders, invoices).collect()}
    assert got == {(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, None, 1, None), (None, 1, None, None), (None, None, 1, None)}


def test_runs_become_one_space(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(" ab1я%-\t\n_№😀é", k=rng.randint(0, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", normalize_product_name("t").alias("p"), normalize_catalog_text("t").alias("c"), F.lit(1)
    )
    for r in rows.collect():
        assert r.p == re.sub(r"[^a-zа-я0-9%.,\-]+", " ", r.t).strip(" ")
        assert r.c == re.sub(r"[^a-zа-я0-9]+", " ", r.t).strip(" ")
