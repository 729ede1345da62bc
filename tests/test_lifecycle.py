"""Corrections against a plain loop, correction texts, suppliers, catalogs, exports."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from goodsledger.functions.corrections import parse_correction
from goodsledger.operators import catalog as catalogs
from goodsledger.operators import lifecycle
from goodsledger.schemas import CATALOG, CORRECTIONS, RECEIVING_ITEMS, RECEIVINGS, conform


def test_correction_text(spark):
    texts = ["Кефир пришло 4 штуки, подтвердить", "Сметана не принимать", "Хлеб цена 35,5", "Соль зачеркнуто", "Масло"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(parse_correction("text").alias("p")).select("p.*")
    got = {r.comment: (r.action, r.quantity, r.price) for r in df.collect()}
    assert got == {
        texts[0]: ("set_quantity", 4.0, None), texts[1]: ("reject", None, None), texts[2]: ("set_price", 35.5, 35.5),
        texts[3]: ("mark_crossed_out", None, None), texts[4]: ("mark_received", None, None),
    }


def test_corrections_fold_equals_sequential_loop(spark):
    rng = random.Random(3)
    actions = ["mark_received", "reject", "set_quantity", "set_price", "accept_extra", "mark_crossed_out", "manual_review", "other"]
    items = [
        {"receiving_id": g, "item_pos": p, "item_name_from_order": f"item{p}", "item_name_from_invoice": None,
         "ordered_quantity": 1.0, "received_quantity": 1.0, "unit": "шт", "ordered_price": 1.0, "invoice_price": 1.0,
         "status": "matched", "comment": "old"}
        for g in range(20) for p in range(1, 5)
    ]
    corrections = [
        (g, s, rng.choice([1, 2, 3, 4, 9]), None, rng.choice(actions), rng.choice([None, 7.0, 8.0]), rng.choice([None, 3.0]), rng.choice([None, "", f"c{s}"]))
        for g in range(20) for s in range(12)
    ]
    state = {(i["receiving_id"], i["item_pos"]): dict(i) for i in items}
    for g, s, pos, _, action, quantity, price, comment in corrections:
        item = state.get((g, pos))
        if item is None:
            continue
        if action in ("mark_received", "accept_extra"):
            item["status"] = "accepted" if action == "mark_received" else "extra_accepted"
            if quantity is not None:
                item["received_quantity"] = quantity
            if action == "accept_extra":
                item["comment"] = comment or lifecycle.COMMENT_ACCEPTED_EXTRA
        elif action == "set_quantity" and quantity is not None:
            item.update(received_quantity=quantity, status="accepted")
        elif action == "set_price" and price is not None:
            item.update(invoice_price=price, status="accepted")
        else:
            item["status"] = {"reject": "rejected", "mark_crossed_out": "crossed_out"}.get(action, "manual_review")
        item["comment"] = comment or item["comment"]
    receivings = conform(spark.range(20).withColumn("status", F.lit("matched_full")), RECEIVINGS)
    frame = spark.createDataFrame([tuple(i[f] for f in RECEIVING_ITEMS.fieldNames()) for i in items], RECEIVING_ITEMS)
    _, after = lifecycle.apply_corrections(receivings, frame, spark.createDataFrame(corrections, CORRECTIONS))
    got = {(r.receiving_id, r.item_pos): r.asDict() for r in after.collect()}
    assert got == state


def plain_lookup(query, items):
    """Position of the item a text means: the last containing name, else the first of the best from 0.25 up."""

    def norm(x):
        return " ".join("".join(c if c.isalnum() or c in "%.,-" else " " for c in (x or "").lower()).split())

    def sim(a, b):
        if not a or not b:
            return 0.0
        if a in b or b in a:
            return 1.0
        s, t = set(a.split()), set(b.split())
        return len(s & t) / len(s | t)

    q = norm(query)
    direct = [pos for pos, a, b in items if q in norm(a) or q in norm(b)]
    if direct:
        return max(direct)
    score, place = max((max(sim(q, norm(a)), sim(q, norm(b))), -pos) for pos, a, b in items)
    return -place if score >= 0.25 else None


def test_corrections_find_items_by_text(spark):
    rng = random.Random(9)
    words = ["milk", "rye", "bread", "salt", "x1", "a", "ab", "red", "12", "blue"]
    text = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    groups = {g: [(p, rng.choice([None, text(4)]), text(3)) for p in range(1, rng.randint(2, 30))] for g in range(12)}
    asked = [(g, s, rng.choice(["?!", "zz", "mil", "alt", *(text(4) for _ in range(6))])) for g in groups for s in range(25)]
    items = spark.createDataFrame([(g, *row) for g, rows in groups.items() for row in rows], "receiving_id long, item_pos long, item_name_from_order string, item_name_from_invoice string")
    corrections = spark.createDataFrame([(g, s, None, q) for g, s, q in asked], "receiving_id long, seq long, item_id long, item_query string")
    want = {(g, s): plain_lookup(q, groups[g]) if q else None for g, s, q in asked}
    for pairs in (-1, 300, 10**9):
        got = {(r.receiving_id, r.seq): r.item_pos for r in lifecycle.locate_corrections(corrections, items, indexed_pairs=pairs).collect()}
        assert got == want, pairs


def test_a_large_receiving_needs_no_pair_table(spark):
    """20,000 lines and 2,000 texts of one receiving: 40 million pairs, of which the indexes join few."""
    items = spark.range(20_000).selectExpr(
        "1L as receiving_id", "id + 1 as item_pos", "concat('milk bread ', id, ' g', id % 977) as item_name_from_order",
        "cast(null as string) as item_name_from_invoice",
    )
    corrections = spark.range(2_000).selectExpr("1L as receiving_id", "id as seq", "cast(null as long) as item_id", "concat('bread ', id * 10) as item_query")
    got = lifecycle.locate_corrections(corrections, items).selectExpr("seq", "item_pos").collect()
    assert len(got) == 2_000
    names = [f"milk bread {i} g{i % 977}" for i in range(20_000)]
    for r in got[:40]:
        assert r.item_pos == max(i + 1 for i, n in enumerate(names) if f"bread {r.seq * 10}" in n)


def test_supplier_mismatch(spark):
    pairs = [("Северный берег", "ООО Северный берег"), ("Северный берег", "ООО Южный ветер"), ("Северный берег", None)]
    df = spark.createDataFrame(pairs, "a string, b string").select(lifecycle.supplier_differs("a", "b").alias("d"))
    assert [r.d for r in df.collect()] == [False, True, False]


def test_catalog_match_equals_full_scan(spark):
    rng = random.Random(5)
    letters = "абвг де"
    entities = [(k, "".join(rng.choices(letters, k=rng.randint(2, 9)))) for k in range(60)]
    names = sorted({"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(50)})
    cat = conform(
        spark.createDataFrame(entities, "entity_pos long, name string").withColumns(
            {"kind": F.lit("product"), "id": F.concat(F.lit("P"), F.col("entity_pos"))}
        ), CATALOG)

    def norm(x):
        return " ".join(x.split())

    def score(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        if a in b or b in a:
            return max(0.75, min(len(a), len(b)) / max(len(a), len(b)))
        return SequenceMatcher(None, a, b).ratio()

    want = {}
    for name in names:
        best, top = None, 0.0
        for k, entity in entities:
            s = score(norm(name), norm(entity))
            if s > top:
                best, top = k, s
        want[name] = (f"P{best}" if top >= 0.55 else None, round(top, 9))
    texts = catalogs.catalog_texts(cat, "product")
    q = spark.createDataFrame([(norm(n),) for n in names if norm(n)], "q string").distinct()
    blocked = {r.q: round(r.score, 9) for r in catalogs.best_texts(q, texts).collect()}
    got = {r.name: (r.value, round(r.confidence, 9)) for r in catalogs.match_names(spark.createDataFrame([(n,) for n in names], "name string"), cat, "product").collect()}
    assert got == want
    assert all(blocked.get(norm(n), 0.0) == want[n][1] for n in names)


def test_single_store_and_missing_units(spark):
    cat = conform(spark.createDataFrame([("store", 0, "ST", "Кухня")], "kind string, entity_pos long, id string, name string"), CATALOG)
    store = catalogs.match_stores(spark.createDataFrame([("",)], "name string"), cat).collect()[0]
    assert (store.value, store.confidence, store.status) == ("ST", 0.6, "auto_single")
    unit = catalogs.match_units(spark.createDataFrame([("кг",)], "name string"), cat).collect()[0]
    assert (unit.value, unit.confidence, unit.status) == ("кг", 0.4, "fallback")
