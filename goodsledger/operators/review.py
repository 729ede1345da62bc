"""Invoice review: intake, stored metadata, validation, update, sheet synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.functions.arrays import exploded
from goodsledger.functions.dates import valid_offset, valid_zone
from goodsledger.functions.numbers import (
    float_text,
    line_sum_or_default,
    parse_vat_percent,
    round_even,
)
from goodsledger.functions.text import as_col, blank_to_null
from goodsledger.operators import catalog as catalogs
from goodsledger.operators.lifecycle import latest_documents
from goodsledger.schemas import META, META_HEADER, META_ITEM

# Texts of the review.
COMMENT_UPLOADED = "MVP-4: накладная загружена для ручной проверки перед отправкой в iiko"
CATALOGS_ABSENT = "Справочники iiko недоступны; технические поля требуют проверки"
UNKNOWN_SUPPLIER = "Поставщик не распознан"
UNKNOWN_VENUE = "Точка доставки не распознана"
NO_SURE_MATCH = "нет уверенного совпадения"
REVIEW_SOURCE = "invoice_review_mvp4"

# Technical keys that survive a sheet update.
TECHNICAL_KEYS = (
    "iiko_product_id",
    "product_article",
    "supplier_product",
    "supplier_product_article",
    "amount_unit",
    "store_id",
    "mapping_status",
    "mapping_error",
    "iiko_product_name",
    "iiko_product_match_confidence",
    "iiko_unit_name",
    "iiko_unit_match_confidence",
)
_HEADER_INPUTS = (
    "iiko_supplier_id", "document_number", "incoming_date", "due_date", "document_form", "supplier_inn",
    "consignee", "recipient", "basis", "total_sum", "iiko_default_store_id", "iiko_organization",
    "iiko_organization_id",
)


# ---------------------------------------------------------------- stored metadata

def parse_document_meta(text: Column | str) -> Column:
    """Stored JSON to struct(header, items). A bare list has an empty header; bad JSON yields empty parts."""
    text = as_col(text)
    wrapped = F.from_json(text, META)
    listed = F.from_json(F.when(F.ltrim(text).startswith("["), text), "array<" + META_ITEM.simpleString() + ">")
    empty_header = F.from_json(F.lit("{}"), META_HEADER)
    is_list = F.ltrim(text).startswith("[")
    return F.struct(
        F.coalesce(F.when(~is_list, wrapped["header"]), empty_header).alias("header"),
        F.coalesce(F.when(is_list, listed).otherwise(wrapped["items"]), F.array().cast("array<" + META_ITEM.simpleString() + ">")).alias("items"),
    )


def document_headers(documents: DataFrame) -> DataFrame:
    """Newest document of each receiving with its parsed metadata header."""
    return latest_documents(documents).withColumn("header", parse_document_meta("recognized_items_json")["header"])


def document_meta_lines(documents: DataFrame) -> DataFrame:
    """Metadata entries of the newest documents, one row each: ``(receiving_id, item_pos, meta)``."""
    items = parse_document_meta("recognized_items_json")["items"]
    parsed = exploded(latest_documents(documents), items, "at", "meta", "receiving_id")
    return parsed.select("receiving_id", (F.col("at") + 1).cast("long").alias("item_pos"), "meta")


def with_meta(items: DataFrame, meta_lines: DataFrame) -> DataFrame:
    """Items with the metadata entry of the same position, null where there is none.

    ``meta_lines`` come from ``document_meta_lines`` or ``stored_meta_lines``.
    """
    return items.join(meta_lines, ["receiving_id", "item_pos"], "left")


# ---------------------------------------------------------------- intake

def _get(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def header_payload(reviews: DataFrame) -> DataFrame:
    """Stored header columns of review requests: trade point from the venue, warehouse from the stores."""
    def text(name: str) -> Column:
        return F.nullif(_get(reviews, name), F.lit(""))

    store, warehouse, default = text("display_store"), text("warehouse"), text("iiko_default_store_id")
    computed = {
        "trade_point": F.coalesce(text("trade_point"), _get(reviews, "venue")),
        "warehouse": F.coalesce(warehouse, store, default),
        "display_store": F.coalesce(store, warehouse, default),
        "user_timezone": valid_zone(_get(reviews, "user_timezone")),
        "user_utc_offset_minutes": valid_offset(_get(reviews, "user_utc_offset_minutes", "int")),
        "multipage_invoice": F.coalesce(_get(reviews, "multipage_invoice", "boolean"), F.lit(False)),
    }
    return reviews.select(
        "receiving_id",
        *[_get(reviews, n, "double" if n == "total_sum" else "string").alias(n) for n in _HEADER_INPUTS],
        *[column.alias(name) for name, column in computed.items()],
    )


def review_lines(reviews: DataFrame) -> DataFrame:
    """Recognized items of review requests as stored lines, positions from 1."""
    lines = exploded(reviews, F.col("items"), "at", "it", "receiving_id")
    have = {f.name for f in reviews.schema["items"].dataType.elementType.fields}

    def field(name: str, kind: str = "string") -> Column:
        return F.col("it")[name].cast(kind) if name in have else F.lit(None).cast(kind)

    zero = F.lit(0.0)
    quantity, price = F.coalesce(field("quantity", "double"), zero), F.coalesce(field("price", "double"), zero)
    position = (F.col("at") + 1).cast("long")
    passed = (
        "iiko_product_id", "product_article", "supplier_product", "supplier_product_article", "store_id",
        "mapping_status", "mapping_error", "comment",
    )
    return lines.select(
        "receiving_id",
        position.alias("item_pos"),
        F.coalesce(F.nullif(field("line_number", "long"), F.lit(0)), position).alias("line_number"),
        field("name").alias("name"),
        quantity.alias("quantity"),
        field("unit").alias("unit"),
        F.coalesce(F.nullif(field("amount_unit"), F.lit("")), field("unit")).alias("amount_unit"),
        price.alias("price"),
        line_sum_or_default(field("sum", "double"), quantity, price).alias("sum"),
        field("sum", "double").alias("given_sum"),
        field("vat").alias("vat"),
        F.coalesce(field("vat_percent", "double"), parse_vat_percent(field("vat"))).alias("vat_percent"),
        field("vat_percent", "double").alias("given_vat_percent"),
        field("vat_sum", "double").alias("vat_sum"),
        field("confidence", "double").alias("confidence"),
        *[field(n).alias(n) for n in passed],
    )


def item_is_complete(name: Column, quantity: Column, price: Column) -> Column:
    zero = F.lit(0.0)
    return (
        (F.coalesce(name, F.lit("")) != "") & (F.coalesce(quantity, zero) > 0) & (F.coalesce(price, zero) >= 0)
    )


def item_comment(lines: DataFrame) -> Column:
    """Row comment: VAT and catalog tags, the person's comment, and a sum that does not multiply out."""
    zero = F.lit(0.0)
    expected = round_even(F.coalesce("quantity", zero) * F.coalesce("price", zero))
    given = F.col("given_sum")

    def tag(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value)

    off = F.abs(given - expected) > 0.01
    said = F.concat_ws(
        "; ",
        tag("НДС", F.col("vat")),
        tag("vatPercent", float_text(F.col("given_vat_percent"))),
        tag("vatSum", float_text(F.col("vat_sum"))),
        tag("iiko_product_id", F.nullif("iiko_product_id", F.lit(""))),
        tag("productArticle", F.nullif("product_article", F.lit(""))),
        tag("confidence", float_text(F.col("confidence"))),
        F.nullif("comment", F.lit("")),
        F.when(
            off,
            F.concat(
                F.lit("Расхождение суммы: распознано "), float_text(given), F.lit(", рассчитано "), float_text(expected)
            ),
        ),
    )
    return F.nullif(said, F.lit(""))


def review_items(lines: DataFrame) -> DataFrame:
    """Receiving items of reviewed lines; incomplete ones wait for a person."""
    return lines.select(
        "receiving_id",
        "item_pos",
        F.lit(None).cast("string").alias("item_name_from_order"),
        F.col("name").alias("item_name_from_invoice"),
        F.lit(0.0).alias("ordered_quantity"),
        F.col("quantity").alias("received_quantity"),
        F.coalesce(F.nullif("unit", F.lit("")), F.lit("шт")).alias("unit"),
        F.lit(0.0).alias("ordered_price"),
        F.col("price").alias("invoice_price"),
        F.when(item_is_complete(F.col("name"), F.col("quantity"), F.col("price")), "accepted")
        .otherwise("manual_review")
        .alias("status"),
        item_comment(lines).alias("comment"),
    )


def map_review(headers: DataFrame, lines: DataFrame, catalog: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Catalog mapping of stored headers and lines; without catalogs missing ids are only marked."""
    if catalog is None:
        return catalogs.mark_headers_unmapped(headers), catalogs.mark_items_unmapped(lines, CATALOGS_ABSENT)
    filled = catalogs.fill_headers(headers, catalog)
    return filled, catalogs.fill_items(lines, filled, catalog)


def create_reviews(
    reviews: DataFrame, catalog: DataFrame | None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Review requests to (receivings, headers, lines, items), mapped to the catalogs.

    ``reviews`` hold ``receiving_id``, ``created_at``, the header columns and ``items`` (array of structs). The
    metadata stays relational: ``headers`` one row per review, ``lines`` one row per recognized item.
    """
    def text(name: str) -> Column:
        return blank_to_null(_get(reviews, name))

    number = text("invoice_number")
    supplier = F.coalesce(text("supplier"), F.lit(""))
    venue = F.coalesce(text("venue"), text("trade_point"), text("iiko_organization"), F.lit(""))
    order_number = F.coalesce(
        number, F.concat(F.lit("MANUAL-"), F.date_format("created_at", "yyyyMMddHHmmss"))
    )
    receivings = reviews.select(
        F.col("receiving_id").alias("id"),
        F.coalesce(F.nullif(_get(reviews, "request_id"), F.lit("")), F.concat(F.lit("MVP4-"), order_number)).alias("request_id"),
        order_number.alias("order_number"),
        venue.alias("venue"),
        supplier.alias("supplier"),
        F.lit("ocr_processed").alias("status"),
        F.lit(COMMENT_UPLOADED).alias("comment"),
        F.col("created_at"),
    )
    lines = review_lines(reviews)
    headers = header_payload(reviews).join(
        receivings.select(F.col("id").alias("receiving_id"), "supplier", "venue"), "receiving_id"
    )
    mapped_headers, mapped_lines = map_review(headers, lines, catalog)
    return receivings, mapped_headers, mapped_lines, review_items(lines)


def stored_meta(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Metadata as stored JSON, one row for the header (position 0) and one for each line.

    ``(receiving_id, item_pos, recognized_items_json)``; each text has the shape ``parse_document_meta`` reads.
    """
    item_fields = [f.name for f in META_ITEM.fields if f.name in lines.columns]
    head_fields = [f.name for f in META_HEADER.fields if f.name in headers.columns]
    keep = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(F.struct(*head_fields).alias("header"), F.array().alias("items")), keep)
    line = F.to_json(F.struct(F.struct(F.lit(None).cast("string").alias("iiko_supplier_id")).alias("header"), F.array(F.struct(*item_fields)).alias("items")), keep)
    return headers.select(
        "receiving_id", F.lit(0).cast("long").alias("item_pos"), head.alias("recognized_items_json")
    ).unionByName(lines.select("receiving_id", F.col("item_pos").cast("long").alias("item_pos"), line.alias("recognized_items_json")))


def stored_headers(stored: DataFrame) -> DataFrame:
    """``(receiving_id, header)`` of metadata stored by ``stored_meta``."""
    heads = stored.where(F.col("item_pos") == 0)
    return heads.select("receiving_id", parse_document_meta("recognized_items_json")["header"].alias("header"))


def stored_meta_lines(stored: DataFrame) -> DataFrame:
    """``(receiving_id, item_pos, meta)`` of metadata stored by ``stored_meta``; broken lines are left out."""
    lines = stored.where(F.col("item_pos") > 0)
    meta = F.get(parse_document_meta("recognized_items_json")["items"], 0)
    return lines.select("receiving_id", "item_pos", meta.alias("meta")).where(F.col("meta").isNotNull())


# ---------------------------------------------------------------- update

def merge_technical(new_lines: DataFrame, old_lines: DataFrame) -> DataFrame:
    """New lines with the technical keys of the stored line of the same number, where theirs are empty.

    Lines meet by line number as text (position when absent); of several stored lines with one number the
    last counts.
    """
    def number(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "_line", F.coalesce(F.nullif(F.col("line_number"), F.lit(0)), F.col("item_pos")).cast("string")
        )

    kept = [k for k in TECHNICAL_KEYS if k in old_lines.columns] + ["vat_percent", "vat_sum"]
    old = (
        number(old_lines)
        .groupBy("receiving_id", "_line")
        .agg(F.max_by(F.struct(*kept), "item_pos").alias("old"))
    )
    joined = number(new_lines).join(old, ["receiving_id", "_line"], "left").drop("_line")
    merged = {}
    for key in kept:
        stored = F.col("old")[key]
        if key not in new_lines.columns:
            merged[key] = stored
        elif key in ("vat_percent", "vat_sum") or key.endswith("_confidence"):
            merged[key] = F.coalesce(F.col(key), stored)
        else:
            merged[key] = F.coalesce(F.nullif(F.col(key), F.lit("")), F.nullif(stored, F.lit("")), F.col(key))
    return joined.withColumns(merged).drop("old")


def merge_headers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored headers overridden by every non-empty new value."""
    shared = [c for c in old.columns if c != "receiving_id" and c in new.columns]
    fresh = new.select("receiving_id", *[F.col(c).alias("_" + c) for c in shared])
    types = {f.name: f.dataType.simpleString() for f in new.schema.fields}

    def newer(name: str) -> Column:
        value = F.col("_" + name)
        return F.nullif(value, F.lit("")) if types[name] == "string" else value

    joined = old.join(fresh, "receiving_id", "left")
    return joined.withColumns({c: F.coalesce(newer(c), F.col(c)) for c in shared}).drop(
        *["_" + c for c in shared]
    )


def update_reviews(
    receivings: DataFrame,
    old_headers: DataFrame,
    old_lines: DataFrame,
    updates: DataFrame,
    catalog: DataFrame | None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Corrected requests over stored reviews: (receivings, headers, lines, items) of the updated ones.

    ``old_headers`` hold the stored header columns; supplier and venue come from the update or the receiving.
    """
    def text(name: str) -> Column:
        return F.nullif(_get(updates, name), F.lit(""))

    asked = updates.select(
        F.col("receiving_id").alias("id"),
        F.coalesce(text("venue"), text("trade_point"), text("iiko_organization")).alias("u_venue"),
        text("supplier").alias("u_supplier"),
        text("invoice_number").alias("u_number"),
    )
    updated = (
        receivings.join(asked, "id")
        .withColumns(
            {
                "venue": F.coalesce("u_venue", "venue"),
                "supplier": F.coalesce("u_supplier", "supplier"),
                "order_number": F.coalesce("u_number", "order_number"),
                "status": F.lit("ocr_processed"),
            }
        )
        .select(*receivings.columns)
    )
    lines = review_lines(updates)
    merged_lines = merge_technical(lines, old_lines)
    names = updated.select(F.col("id").alias("receiving_id"), "supplier", "venue")
    merged = merge_headers(old_headers.drop("supplier", "venue"), header_payload(updates)).join(names, "receiving_id")
    headers, mapped = map_review(merged, merged_lines, catalog)
    return updated, headers, mapped, review_items(lines)


# ---------------------------------------------------------------- validation

def review_issues(
    receivings: DataFrame, items: DataFrame, headers: DataFrame, documents: DataFrame, lines: DataFrame
) -> DataFrame:
    """Distinct issue messages in first-seen order: ``(receiving_id, seq, message)``.

    ``headers`` and ``lines`` are the stored metadata (lines pair with items by position). Messages stay
    rows: nothing is gathered per receiving.
    """
    def empty(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    newest = latest_documents(documents).select(
        F.col("receiving_id").alias("id"), "invoice_number", "invoice_date", F.lit(True).alias("has_document")
    )
    # presence only: one row per receiving after the map-side combine
    counted = items.groupBy(F.col("receiving_id").alias("id")).agg(F.count(F.lit(1)).alias("n_items"))
    head_columns = ("iiko_mapping_status", "iiko_mapping_error", "iiko_supplier_id", "iiko_default_store_id")
    heads = headers.select(
        F.col("receiving_id").alias("id"),
        *[_get(headers, c).alias(c) for c in (*head_columns, "target_warehouse")],
    )
    base = (
        receivings.select("id", "supplier", "venue").join(newest, "id", "left").join(counted, "id", "left").join(heads, "id", "left")
    )
    documented = F.coalesce("has_document", F.lit(False))
    rules = [
        (empty("supplier") | (F.col("supplier") == UNKNOWN_SUPPLIER), F.lit("не распознан поставщик")),
        (empty("venue") | (F.col("venue") == UNKNOWN_VENUE), F.lit("не распознана точка доставки / организация")),
        (~documented, F.lit("не загружена накладная")),
        (documented & empty("invoice_number"), F.lit("не распознан номер накладной")),
        (documented & empty("invoice_date"), F.lit("не распознана дата накладной")),
        (
            F.col("iiko_mapping_status") == "needs_review",
            F.concat(
                F.lit("требуется проверка сопоставления шапки накладной: "),
                F.coalesce(F.nullif("iiko_mapping_error", F.lit("")), F.lit(NO_SURE_MATCH)),
            ),
        ),
        (empty("iiko_supplier_id"), F.lit("не указан поставщик iiko/supplier id")),
        (empty("iiko_default_store_id") & empty("target_warehouse"), F.lit("не указан склад iiko/defaultStore")),
        (F.coalesce("n_items", F.lit(0)) == 0, F.lit("нет товарных позиций")),
    ]
    header_issues = exploded(base, _messages(rules), "at", "message", F.col("id").alias("receiving_id")).select(
        "receiving_id", F.col("at").cast("long").alias("seq"), "message"
    )

    wanted = ("mapping_status", "mapping_error", "iiko_product_id", "product_article", "sum")
    meta = lines.select("receiving_id", "item_pos", *[_get(lines, c, "double" if c == "sum" else "string").alias(c) for c in wanted])
    joined = items.join(meta, ["receiving_id", "item_pos"], "left")
    zero = F.lit(0.0)
    name = F.coalesce(
        F.nullif("item_name_from_invoice", F.lit("")), F.nullif("item_name_from_order", F.lit("")),
        F.concat(F.lit("строка "), F.col("item_pos").cast("string")),
    )
    quantity, price = F.coalesce("received_quantity", zero), F.coalesce("invoice_price", zero)

    def about(text: str) -> Column:
        return F.concat(F.lit(text + " по позиции: "), name)

    item_rules = [
        (
            F.col("mapping_status") == "needs_review",
            F.concat(
                F.lit("требуется проверка сопоставления по позиции: "), name, F.lit(" ("),
                F.coalesce(F.nullif("mapping_error", F.lit("")), F.lit(NO_SURE_MATCH)), F.lit(")"),
            ),
        ),
        (empty("iiko_product_id") & empty("product_article"), about("нет iiko product/productArticle")),
        (quantity <= 0, about("некорректное количество")),
        (price < 0, about("некорректная цена")),
        (F.coalesce(F.col("sum"), round_even(quantity * price)) < 0, about("нет или некорректная sum")),
    ]
    item_issues = exploded(joined, _messages(item_rules), "at", "message", "receiving_id", "item_pos").select("receiving_id", (F.col("item_pos") * 10 + F.col("at")).alias("seq"), "message")
    return (
        header_issues.unionByName(item_issues)
        .groupBy("receiving_id", "message")
        .agg(F.min("seq").alias("seq"))
        .select("receiving_id", "seq", "message")
    )


def _messages(rules: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, message) for test, message in rules]))


def review_status(receivings: DataFrame, issues: DataFrame) -> DataFrame:
    """``(receiving_id, n_issues, status)``: ready without issues, else needs_review."""
    counts = issues.groupBy(F.col("receiving_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return receivings.select("id").join(counts, "id", "left").select(
        F.col("id").alias("receiving_id"),
        F.coalesce("n", F.lit(0)).alias("n_issues"),
        F.when(F.coalesce("n", F.lit(0)) == 0, "ready").otherwise("needs_review").alias("status"),
    )


def approval_gate(
    statuses: DataFrame, approvals: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Reviews that may be sent, and the blocked ones with a reason.

    ``approvals(receiving_id, approved, allow_with_warnings)``: nothing passes unapproved; issues block unless
    warnings are allowed.
    """
    joined = approvals.join(statuses, "receiving_id")
    reason = F.when(
        ~F.col("approved"), "Перед отправкой пользователь должен подтвердить проверку накладной"
    ).when(
        (F.col("n_issues") > 0) & ~F.col("allow_with_warnings"), "Накладная требует проверки"
    )
    judged = joined.withColumn("error_message", reason)
    return judged.where(F.col("error_message").isNull()).drop("error_message"), judged.where(
        F.col("error_message").isNotNull()
    )
