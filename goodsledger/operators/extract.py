"""Recognized document texts to headers and item rows, for a whole table of documents.

Parsing is row-local and without Python; ``spread`` deals the documents out before it. Input ``(…, text)``; every
other column passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goodsledger.functions.arrays import exploded, hold
from goodsledger.functions.documents import (
    document_form,
    is_cash_receipt,
    is_continuation_page,
    is_transfer_document,
)
from goodsledger.functions.numbers import round_even
from goodsledger.operators import extract_header as head
from goodsledger.operators.extract_items import with_items
from goodsledger.sources.documents import with_lines

# Notes attached to every parsed document.
PARSER_NOTES = (
    "Поля распознаны автоматически через Google Drive OCR и должны быть проверены пользователем в Google Таблице.",
    "Если товарные строки не распознаны, заполните их вручную в таблице перед отправкой.",
)
# Marks of documents left to a person.
PARSED_BY_RULES = "deterministic_parser"
MANUAL_REVIEW = "manual_review_empty_sheet"
MANUAL_NOTES = (
    "Встроенный regex parser не нашел полезные поля накладной.",
    "Создана пустая Google Таблица для ручной проверки и заполнения накладной.",
)

HEADER_COLUMNS = (
    "supplier", "supplier_legal_name", "invoice_number", "invoice_date", "document_form", "supplier_inn",
    "consignee", "recipient", "trade_point", "warehouse", "basis", "venue", "delivery_address", "store",
    "display_store", "iiko_default_store_id", "total_sum",
)


def spread(documents: DataFrame) -> DataFrame:
    """Spread documents over all shuffle partitions before parsing.

    Parsing is heavy per byte. Adaptive execution merges small shuffle partitions by bytes, which would leave most
    cores idle; an explicit partition count is kept as it is.
    """
    session = documents.sparkSession
    count = max(
        int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism
    )
    return documents.repartition(count)


def with_kind(documents: DataFrame) -> DataFrame:
    """Line arrays and document kind: receipt, universal transfer document, continuation page."""
    lines = F.col("lines")
    staged = with_lines(documents)
    staged = staged.withColumns(
        {
            "joined": F.array_join("raw_lines", "\n"),
            "is_receipt": hold(is_cash_receipt(lines), lines),
            "is_transfer": hold(is_transfer_document(lines), lines),
            "continues": hold(is_continuation_page(lines), lines),
        }
    )
    return staged.withColumn("is_continuation", ~F.col("is_transfer") & F.col("continues"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Header columns, ``total_sum``, ``items`` (array of structs) and ``parser_notes`` per document."""
    keep = documents.columns
    lines, raw, joined = F.col("lines"), F.col("raw_lines"), F.col("joined")
    transfer, blank = F.col("is_transfer"), F.col("is_continuation")
    staged = with_items(with_kind(documents))

    def header(value, otherwise=None):
        """Transfer documents try their own rule first; continuation pages have no header."""
        general = value if otherwise is None else F.coalesce(F.when(transfer, value), otherwise)
        return F.when(~blank, general)

    staged = staged.withColumns(
        {
            "supplier": hold(header(head.transfer_supplier(lines), head.supplier(lines)), lines),
            "invoice_number": hold(
                header(head.transfer_invoice_number(lines), head.invoice_number(raw, joined)), lines, raw
            ),
            "invoice_date": hold(header(head.transfer_invoice_date(lines), head.invoice_date(joined)), lines),
            "consignee": hold(header(head.party_by_label(lines, "грузополучатель")), lines),
            "buyer": hold(header(head.party_by_label(lines, "покупатель")), lines),
            "store": hold(header(head.store(lines)), lines),
            "named_recipient": hold(header(head.recipient(lines)), lines),
            "basis": hold(
                header(head.transfer_basis(lines), head.basis(lines)), lines
            ),
            "printed_receipt_total": hold(head.receipt_total(lines), lines),
            "printed_page_total": hold(
                F.when(F.col("continues"), head.continuation_total(lines, F.col("table_start"))), lines
            ),
            "printed_total": hold(head.explicit_total(raw, joined), raw),
        }
    )
    venue = F.coalesce("consignee", "buyer")
    item_total = round_even(
        F.aggregate(
            "items",
            F.lit(0.0),
            lambda acc, x: acc + F.coalesce(x["sum"], F.lit(0.0)) + F.coalesce(x["vat_sum"], F.lit(0.0)),
        )
    )
    staged = staged.withColumns(
        {
            "supplier_inn": hold(
                header(
                    head.transfer_supplier_tax_id(lines, F.col("supplier")),
                    head.supplier_tax_id(lines, F.col("supplier")),
                ),
                lines,
            ),
            "venue": venue,
            "recipient": F.coalesce("named_recipient", venue),
            "item_total": item_total,
        }
    )
    total = F.coalesce(
        F.when(F.col("is_receipt"), F.col("printed_receipt_total")),
        F.col("printed_page_total"),
        F.col("printed_total"),
        F.when(F.col("item_total") > 0, F.col("item_total")),
        F.col("printed_receipt_total"),
    )
    return staged.select(
        *keep,
        "supplier",
        F.col("supplier").alias("supplier_legal_name"),
        "invoice_number",
        "invoice_date",
        document_form("joined").alias("document_form"),
        "supplier_inn",
        "consignee",
        "recipient",
        F.col("venue").alias("trade_point"),
        F.col("store").alias("warehouse"),
        "basis",
        "venue",
        F.col("venue").alias("delivery_address"),
        "store",
        F.col("store").alias("display_store"),
        F.col("store").alias("iiko_default_store_id"),
        total.alias("total_sum"),
        "items",
        F.array(*[F.lit(n) for n in PARSER_NOTES]).alias("parser_notes"),
    )


def item_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per item with its position from 1."""
    return exploded(parsed, F.col("items"), "at", "item", *keys).select(
        *keys, (F.col("at") + 1).alias("item_pos"), "item.*"
    )


def route_useful(parsed: DataFrame) -> DataFrame:
    """Mark documents with any item or header value as parsed; the others become empty records for a person.

    An empty record has no header values and no items, its own two notes, and the text as it was.
    """
    useful = F.size("items") > 0
    for name in HEADER_COLUMNS:
        if name != "supplier_legal_name":
            useful = useful | (F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    marked = parsed.withColumn("_useful", useful)
    emptied = {name: F.when(F.col("_useful"), F.col(name)) for name in HEADER_COLUMNS}
    return marked.withColumns(
        emptied
        | {
            "items": F.when(F.col("_useful"), F.col("items")).otherwise(F.slice("items", 1, 0)),
            "parser_notes": F.when(F.col("_useful"), F.col("parser_notes")).otherwise(F.array(*[F.lit(n) for n in MANUAL_NOTES])),
            "parser_provider": F.when(F.col("_useful"), PARSED_BY_RULES).otherwise(MANUAL_REVIEW),
        }
    ).drop("_useful")
