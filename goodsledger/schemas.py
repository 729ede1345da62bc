"""Table and nested schemas, status vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Item statuses.
ITEM_STATUSES = (
    "matched",
    "missing",
    "extra",
    "extra_accepted",
    "quantity_mismatch",
    "price_mismatch",
    "replacement_candidate",
    "crossed_out",
    "accepted",
    "rejected",
    "manual_review",
)

# Receiving statuses.
RECEIVING_STATUSES = (
    "receiving_waiting",
    "receiving_started",
    "documents_uploaded",
    "ocr_processed",
    "matched_full",
    "matched_partial",
    "has_extra_items",
    "requires_correction",
    "confirmed_full",
    "confirmed_partial",
    "control_required",
    "sent_to_accounting",
    "accounting_error",
)

# Item statuses that count as problems.
PROBLEM_STATUSES = (
    "missing",
    "extra",
    "quantity_mismatch",
    "price_mismatch",
    "replacement_candidate",
    "crossed_out",
    "rejected",
    "manual_review",
)

CONFIRMED_STATUSES = ("confirmed_full", "confirmed_partial")
EXCLUDED_STATUSES = ("rejected", "crossed_out")


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


S, D, L, I, B, TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

RECEIVINGS = _fields(
    ("id", L), ("request_id", S), ("order_number", S), ("venue", S), ("supplier", S),
    ("delivery_address", S), ("chat_id", S), ("user_id", S), ("status", S), ("comment", S),
    ("created_at", TS), ("updated_at", TS),
)
ORDER_ITEMS = _fields(
    ("receiving_id", L), ("item_pos", I), ("name", S), ("quantity", D), ("unit", S), ("price", D),
    ("supplier_product_id", S), ("role", S),
)
DOCUMENTS = _fields(
    ("id", L), ("receiving_id", L), ("file_id", S), ("file_type", S), ("source", S), ("file_url", S),
    ("ocr_status", S), ("raw_text", S), ("recognized_items_json", S), ("supplier_legal_name", S),
    ("invoice_number", S), ("invoice_date", S), ("created_at", TS),
)
RECEIVING_ITEMS = _fields(
    ("receiving_id", L), ("item_pos", L), ("item_name_from_order", S), ("item_name_from_invoice", S),
    ("ordered_quantity", D), ("received_quantity", D), ("unit", S), ("ordered_price", D),
    ("invoice_price", D), ("status", S), ("comment", S),
)
ACCOUNTING_MAPPINGS = _fields(
    ("id", L), ("venue", S), ("supplier_product_name", S), ("normalized_product_name", S),
    ("accounting_product_id", S), ("accounting_product_name", S), ("unit", S), ("status", S),
    ("comment", S), ("created_at", TS),
)
ACCOUNTING_EXPORTS = _fields(
    ("id", L), ("receiving_id", L), ("request_id", S), ("order_number", S), ("target_system", S),
    ("status", S), ("payload_json", S), ("error_message", S), ("created_at", TS),
)
CORRECTIONS = _fields(
    ("receiving_id", L), ("seq", I), ("item_id", L), ("item_query", S), ("action", S),
    ("quantity", D), ("price", D), ("comment", S),
)

# Stored per-document metadata: one entry per recognized line.
META_ITEM = _fields(
    ("line_number", L), ("name", S), ("iiko_product_id", S), ("product_article", S),
    ("supplier_product", S), ("supplier_product_article", S), ("quantity", D), ("unit", S),
    ("amount_unit", S), ("price", D), ("sum", D), ("vat", S), ("vat_percent", D), ("vat_sum", D),
    ("store_id", S), ("mapping_status", S), ("mapping_error", S), ("comment", S), ("confidence", D),
    ("iiko_product_name", S), ("iiko_product_match_confidence", D), ("iiko_unit_name", S),
    ("iiko_unit_match_confidence", D),
)
META_HEADER = _fields(
    ("iiko_supplier_id", S), ("document_number", S), ("incoming_date", S), ("due_date", S),
    ("document_form", S), ("supplier_inn", S), ("consignee", S), ("recipient", S), ("trade_point", S),
    ("warehouse", S), ("basis", S), ("display_store", S), ("total_sum", D), ("iiko_default_store_id", S),
    ("iiko_organization", S), ("iiko_organization_id", S), ("user_timezone", S),
    ("user_utc_offset_minutes", I), ("multipage_invoice", B), ("iiko_mapping_status", S),
    ("iiko_mapping_error", S), ("iiko_supplier_name", S), ("iiko_supplier_match_confidence", D),
    ("iiko_default_store_name", S), ("iiko_default_store_match_confidence", D), ("consignor", S),
    ("shipper", S), ("buyer", S), ("invoice_date", S), ("duplicate_indicator", S), ("target_warehouse", S),
    ("mapping_notes", T.ArrayType(S)),
)
META = _fields(("header", META_HEADER), ("items", T.ArrayType(META_ITEM)))

CATALOG = _fields(
    ("kind", S), ("entity_pos", L), ("id", S), ("name", S), ("code", S), ("num", S), ("legalName", S),
    ("taxpayerIdNumber", S), ("description", S), ("shortName", S), ("taxCategory", S), ("vatPercent", D),
)

# The 39 register columns, in sheet order.
REGISTER_HEADERS = (
    "Статус строки",
    "Корректировка",
    "Дубль",
    "Форма документа",
    "Загрузка",
    "Дата документа",
    "№ Документа",
    "Поставщик",
    "ИНН Поставщика",
    "Грузоотправитель",
    "Получатель",
    "Торговая точка",
    "Склад",
    "Основание",
    "Товар найден в справочнике",
    "Наименование товара из документа",
    "Наименование товара в УС",
    "Ед.изм. в документе",
    "Ед.изм. в УС",
    "Кол-во в документе",
    "Кол-во в УС",
    "Цена за ед-цу",
    "Цена в УС",
    "Стоимость без НДС",
    "Ставка НДС",
    "Сумма НДС",
    "Общая стоимость",
    "Сумма накладной",
    "Дата приема",
    "Принял, Ф.И.О.",
    "Госсистемы",
    "Кол-во в заявке",
    "Цена по прайсу",
    "Предыдущая дата поставки",
    "Предыдущая цена",
    "Отклонение от цены прайса",
    "Время загрузки документа",
    "ID документа",
    "Ссылка на исходный документ",
)


def valid_item_status(status: Column) -> Column:
    return status.isin(*ITEM_STATUSES)


def valid_receiving_status(status: Column) -> Column:
    return status.isin(*RECEIVING_STATUSES)


def conform(df, schema: T.StructType):
    """Select the schema's columns with its types, adding absent ones as nulls."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
