"""Names against accounting catalogs: best match, field fill, tax lookup, counts.

Catalog rows follow ``schemas.CATALOG``: ``kind`` (supplier, product, store, unit, tax), ``entity_pos`` (reading
order) and the entity's fields.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goodsledger.functions.numbers import vat_included
from goodsledger.functions.text import normalize_catalog_text
from goodsledger.operators.candidates import KEY, containing
from goodsledger.operators.nearest import best_in_block, similarity
from goodsledger.session import ensure_checkpoint_dir, ship_package, stored

# Searched fields by kind, thresholds, reasons.
SEARCH_FIELDS = {
    "supplier": ("name", "legalName", "code", "taxpayerIdNumber"),
    "store": ("name", "code"),
    "product": ("name", "num", "code", "description"),
    "unit": ("name", "code", "shortName"),
}
READY_SCORE = 0.72
REVIEW_SCORE = 0.55
SINGLE_STORE_SCORE = 0.6
UNIT_FALLBACK_SCORE = 0.4
NOT_FOUND = {
    "supplier": "поставщик iiko не найден",
    "store": "склад/defaultStore iiko не найден",
    "product": "товар iiko не найден",
    "unit": "единица измерения iiko не найдена",
}
REASON_READY = "сопоставлено автоматически"
REASON_LOW = "низкая уверенность автоматического сопоставления"
REASON_SINGLE_STORE = "выбран единственный склад iiko"
REASON_UNIT_FALLBACK = "единицы iiko недоступны; оставлена OCR-единица"
ERROR_NO_STORE = "не определен склад/defaultStore для позиции"

# Names, or catalog texts, that a task of the search holds.
BLOCK = 50_000
# Texts per piece among which a name finds its first score, the widths of pieces, and the pieces a name asks for.
SEEDS = 8
SEED_WIDTHS = (3, 5, 7)
SEED_PIECES = 3
# Copies of a lookup table row, so that rows of one very frequent name spread over several tasks.
LOOKUP_SALTS = 8


def catalog_texts(catalog: DataFrame, kind: str) -> DataFrame:
    """Distinct searched texts of a kind, each with its first place ``(entity_pos, field_pos)``."""
    fields = SEARCH_FIELDS[kind]
    texts = F.array(*[
        F.struct(F.lit(k).alias("field_pos"), normalize_catalog_text(f).alias("text")) for k, f in enumerate(fields)
    ])
    return (
        catalog.where(F.col("kind") == kind)
        .select("entity_pos", F.inline(texts))
        .where(F.col("text") != "")
        .groupBy("text")
        .agg(F.min(F.struct("entity_pos", "field_pos")).alias("place"))
        .select("text", "place.entity_pos", "place.field_pos")
    )


def _best_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best text of each name among the candidate pairs of a batch.

    The characters two texts share are counted as the common bits of two masks; candidates are measured in falling
    order of that bound, down to the best score found, or to the name's level.
    """
    for batch in batches:
        names, texts = batch.column("q").to_pylist(), batch.column("text").to_pylist()
        bits: dict[tuple[str, int], int] = {}
        masks: dict[str, int] = {}
        for text in {*names, *texts}:
            seen: dict[str, int] = {}
            mask = 0
            for ch in text:
                seen[ch] = seen.get(ch, 0) + 1
                mask |= 1 << bits.setdefault((ch, seen[ch]), len(bits))
            masks[text] = mask
        options: dict[str, set[tuple[float, int, int, str]]] = {}
        levels = batch.column("level").to_pylist()
        places = zip(batch.column("entity_pos").to_pylist(), batch.column("field_pos").to_pylist(), strict=True)
        for name, text, level, place in zip(names, texts, levels, places, strict=True):
            bound = 2 * (masks[name] & masks[text]).bit_count() / (len(name) + len(text))
            if bound >= level - 1e-9:
                options.setdefault(name, set()).add((-bound, *place, text))
        best: list[tuple[str, float, int, int]] = []
        for name, found in options.items():
            top = (0.0, 0, 0)
            for bound, entity, field, text in sorted(found):
                if bound > top[0] + 1e-9:
                    break
                score = -similarity(name, text)
                if score < 0:
                    top = min(top, (score, entity, field))
            if top[0] < 0:
                best.append((name, *top))
        yield _best_columns(best, pa.RecordBatch)


BEST = ("q", "neg", "entity_pos", "field_pos")
BEST_SCHEMA = "q string, neg double, entity_pos long, field_pos long"


def _best_columns(best: list[tuple[str, float, int, int]], kind: type):
    columns = list(zip(*best, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
    return kind.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(BEST))


def _scored(pairs: DataFrame) -> DataFrame:
    ship_package(pairs.sparkSession)
    rows = pairs.select("q", "text", "level", F.col("entity_pos").cast("long"), F.col("field_pos").cast("long"))
    return rows.mapInArrow(_best_of_pairs, BEST_SCHEMA)


def _leaders(*found: DataFrame) -> DataFrame:
    """Best of several results per name: highest score, then first place. Combined on the map side."""
    rows = reduce(DataFrame.unionByName, found)
    best = rows.groupBy("q").agg(F.min(F.struct(*BEST[1:])).alias("best"))
    return best.select("q", "best.*")


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(inner, outer)`` pairs of texts of one column each, the first inside the second."""
    sides = [side.select(F.lit(0).alias(KEY), F.col(side.columns[0]).alias("norm")) for side in (inner, outer)]
    return containing(*sides).select(F.col("left").alias(inner.columns[0]), F.col("right").alias(outer.columns[0]))


def _containing_scores(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that contain a name or lie in it, scored."""
    only = texts.select("text")
    pairs = _contained(names, only).unionByName(_contained(only, names)).join(texts, "text")
    short, long = (pick(F.length("q"), F.length("text")) for pick in (F.least, F.greatest))
    return pairs.select("q", (-F.greatest(F.lit(0.75), short / long)).alias("neg"), F.col("entity_pos").cast("long"), F.col("field_pos").cast("long"))


def _seeds(names: DataFrame, texts: DataFrame) -> DataFrame:
    """A first good text for most names: the shortest ``SEEDS`` texts of each of its rarest pieces.

    Only a start for the bounds of ``_search``, which misses nothing whatever is found here.
    """
    def pieces(text: str) -> Column:
        def cut(width: int) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - width + 1, F.lit(0))), lambda s: s > 0)
            return F.transform(starts, lambda s: F.xxhash64(F.substr(F.col(text), s, F.lit(width))))

        return F.explode(F.array_distinct(F.concat(*map(cut, SEED_WIDTHS)))).alias("piece")

    offered = texts.select("*", pieces("text"))
    frequency = offered.groupBy("piece").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("piece").orderBy(F.length("text"), "text")
    index = offered.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SEEDS).drop("n")
    rarest = names.select("q", pieces("q")).join(frequency, "piece").groupBy("q").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("f", "piece"))), 1, SEED_PIECES).alias("rarest")
    )
    asked = rarest.select("q", F.lit(0.0).alias("level"), F.explode("rarest.piece").alias("piece"))
    return _scored(asked.join(index, "piece"))


def _best_of_groups(names: pa.Table, texts: pa.Table) -> pa.Table:
    places = zip(texts["entity_pos"].to_pylist(), texts["field_pos"].to_pylist(), strict=True)
    found = best_in_block(names["q"].to_pylist(), names["level"].to_pylist(), texts["text"].to_pylist(), list(places))
    return _best_columns(found, pa.Table)


def _blocks(texts: DataFrame) -> tuple[DataFrame, int]:
    """Texts in ranges of about ``BLOCK``, so that texts of one beginning share a block; and how many there are."""
    blocks = -(-texts.count() // BLOCK)
    return texts.repartitionByRange(max(blocks, 1), "text").withColumn("block", F.spark_partition_id()).checkpoint(), blocks


def _search(names: DataFrame, texts: DataFrame, blocks: int) -> DataFrame:
    """Best text among all that can reach a name's ``level``: ``names(q, level)``, ``texts`` in ``blocks``.

    Every part of the names meets every block of the texts in one task, which holds at most a part and a block
    (``nearest.py``). Names are cut into more parts where few blocks would leave cores idle.
    """
    context = names.sparkSession.sparkContext
    ship_package(names.sparkSession)
    parts = max(-(-names.count() // BLOCK), -(-3 * context.defaultParallelism // max(blocks, 1)))
    asked = names.select(
        "q", "level", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block"),
    )
    offered = texts.select(
        "text", F.col("entity_pos").cast("long"), F.col("field_pos").cast("long"), "block",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    # few bytes make much work here: keep the number of tasks that the session names
    keys, tasks = ["part", "block"], max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism)
    sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (asked, offered)]
    return sides[0].cogroup(sides[1]).applyInArrow(_best_of_groups, BEST_SCHEMA)


def best_texts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Best catalog text per distinct normalized name ``q``: ``(q, score, entity_pos, field_pos)``.

    Equal texts are found by an equi-join. For the other names the best text that contains the name or lies in it,
    and the best among a few that share rare pieces, give a score to beat; a search of all texts, cut off where the
    longest common subsequence cannot reach that score, then yields the best (``_search``). Names that stay below
    ``REVIEW_SCORE`` are searched once more, down to their own best score.
    """
    ensure_checkpoint_dir(names.sparkSession)
    names, (texts, blocks) = names.checkpoint(), _blocks(texts.checkpoint())
    equal = names.join(texts.withColumnRenamed("text", "q"), "q").select(
        "q", F.lit(1.0).alias("score"), F.col("entity_pos").cast("long").alias("entity_pos"),
        F.col("field_pos").cast("long").alias("field_pos"),
    )
    open_names = names.join(texts.select(F.col("text").alias("q")), "q", "left_anti").checkpoint()
    if open_names.isEmpty():
        return equal
    score = F.coalesce(-F.col("neg"), F.lit(0.0))
    found = (_containing_scores(open_names, texts), _seeds(open_names, texts))
    first = open_names.join(_leaders(*found), "q", "left").checkpoint()
    likely = _search(first.select("q", F.greatest(score, F.lit(REVIEW_SCORE)).alias("level")), texts, blocks)
    second = open_names.join(_leaders(first.dropna(), likely), "q", "left").checkpoint()
    left = second.where(score < REVIEW_SCORE).select("q", score.alias("level"))
    last = _leaders(second.dropna(), _search(left, texts, blocks))
    return equal.unionByName(last.select("q", (-F.col("neg")).alias("score"), "entity_pos", "field_pos"))


def match_names(names: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """Match result per distinct ``name``: value, entity_name, confidence, status, reason, num, code, tax id.

    Names that normalize to nothing score 0. Below 0.55 no value is given, the best name and score are kept.
    """
    keyed = stored(names.select("name").distinct().withColumn("q", normalize_catalog_text("name")), "catalog_names")
    best = best_texts(
        keyed.where(F.col("q") != "").select("q").distinct(), catalog_texts(catalog, kind)
    )
    entities = catalog.where(F.col("kind") == kind).select(
        "entity_pos",
        F.coalesce(F.nullif("id", F.lit("")), F.nullif("code", F.lit("")), F.nullif("num", F.lit(""))).alias("entity_value"),
        F.col("name").alias("entity_name"),
        "num",
        "code",
        "taxCategory",
    )
    scored = keyed.join(best, "q", "left").join(entities, "entity_pos", "left")
    score = F.coalesce("score", F.lit(0.0))
    return scored.select(
        "name",
        F.when(score >= REVIEW_SCORE, F.col("entity_value")).alias("value"),
        "entity_name",
        score.alias("confidence"),
        F.when(score >= READY_SCORE, "ready").otherwise("needs_review").alias("status"),
        F.when(score >= READY_SCORE, REASON_READY)
        .when(score >= REVIEW_SCORE, REASON_LOW)
        .otherwise(NOT_FOUND[kind])
        .alias("reason"),
        "num",
        "code",
        "taxCategory",
    )


def lookup(rows: DataFrame, table: DataFrame, key: str, *spread: str) -> DataFrame:
    """Left join of ``rows`` with a table unique on ``key``; rows of one frequent key spread by ``spread``.

    The salt is a hash of row columns, so a recomputed task produces the same rows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(LOOKUP_SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def match_stores(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Store matches; a blank name falls back to the only store when the catalog has exactly one."""
    matched = match_names(names, catalog, "store")
    single = catalog.where(F.col("kind") == "store").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.first("id").alias("only_id"), F.first("name").alias("only_name")).alias("single")
    )
    joined = matched.withColumn("single", single.scalar()).select(*matched.columns, "single.*")
    alone = (F.coalesce("name", F.lit("")) == "") & (F.col("n") == 1)
    return joined.withColumns(
        {
            "value": F.when(alone, F.col("only_id")).otherwise(F.col("value")),
            "entity_name": F.when(alone, F.col("only_name")).otherwise(F.col("entity_name")),
            "confidence": F.when(alone, F.lit(SINGLE_STORE_SCORE)).otherwise(F.col("confidence")),
            "status": F.when(alone, "auto_single").otherwise(F.col("status")),
            "reason": F.when(alone, REASON_SINGLE_STORE).otherwise(F.col("reason")),
        }
    ).drop("n", "only_id", "only_name")


def match_units(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unit matches; without a unit catalog the recognized unit is kept with low confidence."""
    matched = match_names(names, catalog, "unit")
    units = catalog.where(F.col("kind") == "unit").agg(F.count(F.lit(1)).alias("n"))
    joined = matched.withColumn("n", units.scalar())
    kept = (F.coalesce("name", F.lit("")) != "") & (F.col("n") == 0)
    return joined.withColumns(
        {
            "value": F.when(kept, F.col("name")).otherwise(F.col("value")),
            "entity_name": F.when(kept, F.col("name")).otherwise(F.col("entity_name")),
            "confidence": F.when(kept, F.lit(UNIT_FALLBACK_SCORE)).otherwise(F.col("confidence")),
            "status": F.when(kept, "fallback").otherwise(F.col("status")),
            "reason": F.when(kept, REASON_UNIT_FALLBACK).otherwise(F.col("reason")),
        }
    ).drop("n")


def tax_percents(catalog: DataFrame) -> DataFrame:
    """Percent by tax id: the first entity with the id decides."""
    return (
        catalog.where((F.col("kind") == "tax") & F.col("id").isNotNull())
        .groupBy(F.col("id").alias("taxCategory"))
        .agg(F.min_by("vatPercent", "entity_pos").alias("tax_percent"))
    )


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- field fill

def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def fill_headers(headers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Supplier and store ids of document headers from the catalogs.

    ``headers`` hold ``receiving_id``, ``supplier``, ``venue`` and the stored header columns (``iiko_supplier_id``,
    ``iiko_default_store_id``, ``iiko_organization``); ids are filled only where empty.
    """
    store_query = F.coalesce(_text("iiko_default_store_id"), _text("iiko_organization"), F.col("venue"))
    asked = headers.withColumn("store_query", F.coalesce(store_query, F.lit(""))).withColumn(
        "supplier_query", F.coalesce("supplier", F.lit(""))
    )

    def wanted(matches: DataFrame, key: str, prefix: str) -> DataFrame:
        return matches.select(
            F.col("name").alias(key), F.col("value").alias(prefix + "value"),
            F.col("entity_name").alias(prefix + "name"), F.col("confidence").alias(prefix + "confidence"),
            F.col("reason").alias(prefix + "reason"),
        )

    suppliers = match_names(asked.select(F.col("supplier_query").alias("name")), catalog, "supplier")
    stores = match_stores(asked.select(F.col("store_query").alias("name")), catalog)
    joined = lookup(asked, wanted(suppliers, "supplier_query", "s_"), "supplier_query", "receiving_id")
    joined = lookup(joined, wanted(stores, "store_query", "t_"), "store_query", "receiving_id")
    filled = joined.withColumns(
        {
            "iiko_supplier_id": F.coalesce(_text("iiko_supplier_id"), F.col("s_value")),
            "iiko_default_store_id": F.coalesce(_text("iiko_default_store_id"), F.col("t_value")),
        }
    )
    errors = F.array_compact(
        F.array(
            F.when(_blank("iiko_supplier_id"), F.col("s_reason")),
            F.when(_blank("iiko_default_store_id"), F.col("t_reason")),
        )
    )
    return filled.withColumns(
        {
            "iiko_supplier_name": F.coalesce(_text("s_name"), F.col("supplier")),
            "iiko_supplier_match_confidence": F.col("s_confidence"),
            "iiko_default_store_name": F.coalesce(_text("t_name"), F.col("iiko_default_store_id")),
            "iiko_default_store_match_confidence": F.col("t_confidence"),
            "iiko_mapping_status": F.when(F.size(errors) == 0, "ready").otherwise("needs_review"),
            "iiko_mapping_error": F.array_join(errors, "; "),
        }
    ).drop(
        "store_query", "supplier_query", "s_value", "s_name", "s_confidence", "s_reason", "t_value", "t_name",
        "t_confidence", "t_reason",
    )


def fill_items(items: DataFrame, headers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Product, article, unit, store and VAT of document lines from the catalogs, only where empty.

    ``items(receiving_id, item_pos, <stored line columns>)``; ``headers`` as returned by ``fill_headers``.
    """
    unit_query = F.coalesce(_text("unit"), _text("amount_unit"), F.lit(""))
    asked = items.withColumn("unit_query", unit_query).withColumn("name", F.coalesce("name", F.lit("")))
    products = match_names(asked.select("name"), catalog, "product").select(
        "name", F.col("value").alias("p_value"), F.col("entity_name").alias("p_name"),
        F.col("confidence").alias("p_confidence"), F.col("reason").alias("p_reason"),
        F.coalesce(F.nullif("num", F.lit("")), F.nullif("code", F.lit(""))).alias("p_article"), "taxCategory",
    ).join(tax_percents(catalog), "taxCategory", "left")
    units = match_units(asked.select(F.col("unit_query").alias("name")), catalog).select(
        F.col("name").alias("unit_query"), F.col("value").alias("u_value"), F.col("entity_name").alias("u_name"),
        F.col("confidence").alias("u_confidence"), F.col("reason").alias("u_reason"),
    )
    stores = headers.select("receiving_id", F.col("iiko_default_store_id").alias("h_store"))
    joined = lookup(asked, products, "name", "receiving_id", "item_pos")
    joined = lookup(joined, units, "unit_query", "receiving_id", "item_pos").join(stores, "receiving_id", "left")
    filled = joined.withColumns(
        {
            "iiko_product_id": F.coalesce(_text("iiko_product_id"), F.col("p_value")),
            "product_article": F.coalesce(_text("product_article"), F.col("p_article")),
            "iiko_product_name": F.coalesce(_text("p_name"), F.col("name")),
            "iiko_product_match_confidence": F.col("p_confidence"),
            "amount_unit": F.coalesce(_text("amount_unit"), _text("u_value"), _text("u_name"), _text("unit"), F.lit("шт")),
            "iiko_unit_name": F.coalesce(_text("u_name"), F.col("unit")),
            "iiko_unit_match_confidence": F.col("u_confidence"),
            "store_id": F.coalesce(_text("store_id"), _text("h_store")),
            "vat_percent": F.coalesce("vat_percent", "tax_percent"),
        }
    )
    total = F.coalesce(F.col("sum"), F.coalesce("quantity", F.lit(0.0)) * F.coalesce("price", F.lit(0.0)))
    filled = filled.withColumn(
        "vat_sum",
        F.coalesce(
            F.col("vat_sum"),
            F.when(F.col("vat_percent").isNotNull(), vat_included(total, F.col("vat_percent"))),
        ),
    )
    errors = F.array_compact(
        F.array(
            F.when(_blank("iiko_product_id") & _blank("product_article"), F.col("p_reason")),
            F.when(_blank("amount_unit"), F.col("u_reason")),
            F.when(_blank("store_id"), F.lit(ERROR_NO_STORE)),
        )
    )
    return filled.withColumns(
        {
            "mapping_status": F.when(F.size(errors) == 0, "ready").otherwise("needs_review"),
            "mapping_error": F.array_join(errors, "; "),
        }
    ).drop(
        "unit_query", "p_value", "p_name", "p_confidence", "p_reason", "p_article", "taxCategory", "tax_percent",
        "u_value", "u_name", "u_confidence", "u_reason", "h_store",
    )


def mark_headers_unmapped(headers: DataFrame) -> DataFrame:
    """Header mapping status when no catalogs are at hand."""
    missing = F.array_compact(
        F.array(
            F.when(_blank("iiko_supplier_id"), "не заполнен iiko_supplier_id"),
            F.when(_blank("iiko_default_store_id"), "не заполнен iiko_default_store_id/defaultStore"),
        )
    )
    return headers.withColumns(
        {
            "iiko_mapping_status": F.when(F.size(missing) == 0, "ready").otherwise("needs_review"),
            "iiko_mapping_error": F.array_join(missing, "; "),
        }
    )


def mark_items_unmapped(items: DataFrame, message: str) -> DataFrame:
    """Line mapping status when no catalogs are at hand: lines with a product id or article stay usable.

    Stored keys win over defaults even when their value is null, so only absent columns are set.
    """
    known = ~(_blank("iiko_product_id") & _blank("product_article"))
    defaults = {
        "amount_unit": F.coalesce(_text("unit"), F.lit("шт")),
        "mapping_status": F.when(known, "ready").otherwise("needs_review"),
        "mapping_error": F.when(~known, F.lit(message)),
    }
    return items.withColumns({k: v for k, v in defaults.items() if k not in items.columns})
