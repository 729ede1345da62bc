"""Line match: reference cases, a plain-loop check, and agreement of both physical plans."""

import random

from pyspark.sql import functions as F

from goodsledger.operators import crowded, lifecycle
from goodsledger.operators.crowded import match_crowded
from goodsledger.operators.matching import match_gathered, match_lines

ORDERS = "receiving_id long, item_pos long, name string, quantity double, unit string, price double"
INVOICES = ORDERS + ", crossed_out boolean, comment string"
MILK, VINEGAR, SAUCE = "Сок берёзовый Роща 900 мл", "Масло льняное Поле 0,5 л", "Горчица зерновая"


def statuses(df):
    return {(r.item_name_from_order, r.item_name_from_invoice): r.status for r in df.collect()}


def orders(spark, rid=1):
    return spark.createDataFrame([(rid, 1, MILK, 6.0, "шт", 310.0), (rid, 2, VINEGAR, 1.0, "шт", 88.4)], ORDERS)


def test_quantity_price_and_extra(spark):
    invoice = spark.createDataFrame(
        [(1, 1, MILK, 2.0, "шт", 310.0, False, None), (1, 2, VINEGAR, 1.0, "шт", 97.0, False, None),
         (1, 3, SAUCE, 1.0, "шт", 120.0, False, None)], INVOICES)
    items = match_lines(orders(spark), invoice)
    assert statuses(items) == {(MILK, MILK): "quantity_mismatch", (VINEGAR, VINEGAR): "price_mismatch", (None, SAUCE): "extra"}
    summary = lifecycle.compare_summary(items).collect()[0]
    assert (summary.quantity_mismatch, summary.price_mismatch, summary.extra) == (1, 1, 1)


def test_crossed_out_extra_and_missing(spark):
    invoice = spark.createDataFrame(
        [(1, 1, MILK, 6.0, "шт", 310.0, False, None), (1, 2, SAUCE, 1.0, "шт", 120.0, True, None)], INVOICES)
    got = statuses(match_lines(orders(spark), invoice))
    assert got == {(MILK, MILK): "matched", (VINEGAR, None): "missing", (None, SAUCE): "crossed_out"}


def test_empty_invoice_is_all_missing(spark):
    got = statuses(match_lines(orders(spark), spark.createDataFrame([], INVOICES)))
    assert set(got.values()) == {"missing"}


def plain_match(order_rows, invoice_rows):
    def norm(x):
        return " ".join(x.lower().split())

    def sim(a, b):
        a, b = norm(a), norm(b)
        if not a or not b:
            return 0.0
        if a in b or b in a:
            return 1.0
        s, t = set(a.split()), set(b.split())
        return len(s & t) / len(s | t)

    used, links = set(), {}
    for op, oname in order_rows:
        best, score = None, 0.0
        for ip, iname in invoice_rows:
            if ip not in used and sim(oname, iname) > score:
                best, score = ip, sim(oname, iname)
        if best is not None and score >= 0.25:
            used.add(best)
            links[op] = best
    return links


def random_sides(seed, groups, size):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "bread", "milk", "rye", "red", "x1", "1", "salt"]

    def side():
        return [(p, " ".join(rng.choices(words, k=rng.choice([0, 1, 1, 2, 3, 4])))) for p in range(1, rng.randint(1, size) + 1)]

    return {g: (side(), side()) for g in range(groups)}


def frames(spark, sides):
    o = [(g, p, n, 1.0, "шт", 1.0) for g, (os, _) in sides.items() for p, n in os]
    i = [(g, p, n, 1.0, "шт", 1.0, False, None) for g, (_, ins) in sides.items() for p, n in ins]
    return spark.createDataFrame(o, ORDERS), spark.createDataFrame(i, INVOICES)


def links_of(df):
    return {
        (r.receiving_id, r.order_pos): r.invoice_pos
        for r in df.where("order_pos is not null and invoice_pos is not null").collect()
    }


def test_gathered_match_equals_plain_loop(spark):
    sides = random_sides(7, 60, 12)
    want = {(g, o): i for g, (os, ins) in sides.items() for o, i in plain_match(os, ins).items()}
    assert links_of(match_gathered(*frames(spark, sides))) == want


def test_crowded_match_equals_plain_loop_and_gathered_rows(spark):
    sides = random_sides(11, 3, 40)
    o, i = frames(spark, sides)
    want = {(g, a): b for g, (os, ins) in sides.items() for a, b in plain_match(os, ins).items()}
    crowded = match_crowded(o, i, span=7)
    assert links_of(crowded) == want
    gathered = match_gathered(o, i)
    assert sorted(map(tuple, crowded.collect()), key=str) == sorted(map(tuple, gathered.select(*crowded.columns).collect()), key=str)


def test_oversized_receivings_take_the_distributed_plan(spark):
    sides = random_sides(13, 4, 9)
    o, i = frames(spark, sides)
    small = match_lines(o, i)
    split = match_lines(o, i, fold_limit=5)
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


def test_result_does_not_depend_on_partitioning(spark):
    o, i = frames(spark, random_sides(17, 30, 8))
    one = match_gathered(o.repartition(1), i.repartition(1)).collect()
    many = match_gathered(o.orderBy(F.rand(1)).repartition(13), i.orderBy(F.rand(2)).repartition(5)).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, many), key=str)


def test_equally_similar_lines_settle_in_few_rounds(spark, monkeypatch):
    """Names that are all alike, each different: the rounds of the distributed plan must not grow with the lines."""
    n = 40
    order = spark.createDataFrame([(1, k, f"сыр заказ{k}", 1.0, "шт", 5.0) for k in range(1, n + 1)], ORDERS)
    invoice = spark.createDataFrame([(1, k, f"сыр накладная{k}", 1.0, "шт", 5.0, False, None) for k in range(1, n + 1)], INVOICES)
    rounds = []
    kept = crowded._ranked
    monkeypatch.setattr(crowded, "_ranked", lambda *a: rounds.append(1) or kept(*a))
    rows = {(r.order_pos, r.invoice_pos) for r in match_crowded(order, invoice).collect()}
    assert rows == {(r.order_pos, r.invoice_pos) for r in match_gathered(order, invoice).collect()}
    assert len(rounds) <= 6
