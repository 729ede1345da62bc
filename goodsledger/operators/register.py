"""The 39-column invoice register: build, merge, document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goodsledger.functions.dates import local_time_text
from goodsledger.functions.documents import document_form, is_continuation_text, labelled_tax_id
from goodsledger.functions.numbers import float_text, gross_sum, line_sum_or_default, vat_display
from goodsledger.functions.text import display_value
from goodsledger.operators.lifecycle import latest_documents
from goodsledger.operators.payloads import document_totals
from goodsledger.schemas import REGISTER_HEADERS
from goodsledger.session import ensure_checkpoint_dir

# The register column behind every header value and item value that is filled in.
HEADER_CELLS = {
    "Форма документа": "document_form",
    "Дата документа": "document_date",
    "№ Документа": "document_number",
    "Поставщик": "supplier",
    "ИНН Поставщика": "supplier_inn",
    "Грузоотправитель": "consignor",
    "Получатель": "recipient",
    "Торговая точка": "trade_point",
    "Склад": "warehouse",
    "Основание": "basis",
    "Сумма накладной": "total_sum",
    "Время загрузки документа": "upload_time",
    "ID документа": "document_id",
}
ITEM_CELLS = {
    "Наименование товара из документа": "name",
    "Ед.изм. в документе": "unit",
    "Кол-во в документе": "quantity",
    "Цена за ед-цу": "price",
    "Стоимость без НДС": "line_sum",
    "Ставка НДС": "vat",
    "Сумма НДС": "vat_sum",
    "Общая стоимость": "line_sum_with_vat",
}


def register_headers(
    receivings: DataFrame, documents: DataFrame, headers: DataFrame, totals: DataFrame
) -> DataFrame:
    """Header cell values per receiving; waybill continuation pages get a blank header."""
    def head(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in headers.columns else F.lit(None)).cast(kind).alias("h_" + name)

    wanted = (
        "document_number", "invoice_date", "incoming_date", "consignor", "shipper", "consignee", "recipient", "buyer",
        "trade_point", "warehouse", "display_store", "iiko_default_store_name", "iiko_default_store_id",
        "supplier_inn", "basis", "document_form", "user_timezone", "duplicate_indicator",
    )
    heads = headers.select(
        "receiving_id", *[head(c) for c in wanted], head("user_utc_offset_minutes", "int"),
        head("multipage_invoice", "boolean"), head("total_sum", "double"),
    )
    newest = latest_documents(documents).select(
        "receiving_id", F.lit(True).alias("has_document"), "raw_text", F.col("invoice_number").alias("d_number"),
        F.col("invoice_date").alias("d_date"), F.col("supplier_legal_name").alias("d_supplier"),
        F.col("created_at").alias("d_created"),
    )
    base = (
        receivings.withColumnRenamed("id", "receiving_id")
        .join(newest, "receiving_id", "left")
        .join(heads, "receiving_id", "left")
        .join(totals.withColumnRenamed("total_sum", "computed_total"), "receiving_id", "left")
    )

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    blank = is_continuation_text("raw_text") & ~F.coalesce("h_multipage_invoice", F.lit(False))
    staged = base.withColumn("blank", blank).withColumn(
        "shown_supplier", display_value(F.coalesce(filled("supplier"), F.col("d_supplier")))
    )
    staged = staged.withColumn(
        "shown_consignee", display_value(F.coalesce(filled("h_consignee"), F.col("venue")))
    )
    number = F.when(F.col("has_document"), F.col("d_number")).otherwise(F.col("order_number"))
    values = {
        "document_date": display_value(F.coalesce(filled("d_date"), filled("h_invoice_date"), filled("h_incoming_date"))),
        "document_number": display_value(F.coalesce(filled("h_document_number"), number)),
        "supplier": F.col("shown_supplier"),
        "supplier_inn": display_value(F.coalesce(filled("h_supplier_inn"), labelled_tax_id("shown_supplier"))),
        "consignor": display_value(F.coalesce(filled("h_consignor"), filled("h_shipper"), F.col("shown_supplier"))),
        "recipient": display_value(F.coalesce(filled("h_recipient"), filled("h_buyer"), F.col("shown_consignee"))),
        "trade_point": display_value(F.coalesce(filled("h_trade_point"), F.col("venue"))),
        "warehouse": display_value(
            F.coalesce(
                filled("h_warehouse"), filled("h_display_store"), filled("h_iiko_default_store_name"),
                filled("h_iiko_default_store_id"),
            )
        ),
        "basis": display_value(F.col("h_basis")),
        "duplicate_indicator": display_value(F.col("h_duplicate_indicator")),
    }
    return staged.select(
        "receiving_id",
        *[F.when(F.col("blank"), F.lit("")).otherwise(v).alias(k) for k, v in values.items()],
        display_value(F.coalesce(filled("h_document_form"), document_form("raw_text"))).alias("document_form"),
        float_text(F.coalesce("h_total_sum", "computed_total", F.lit(0.0))).alias("total_sum"),
        local_time_text(
            F.coalesce("d_created", "created_at"), F.col("h_user_timezone"), F.col("h_user_utc_offset_minutes")
        ).alias("upload_time"),
        F.lit("1").alias("document_id"),
    )


def build_register(
    receivings: DataFrame, items: DataFrame, documents: DataFrame, headers: DataFrame, lines: DataFrame
) -> DataFrame:
    """Register rows ``(receiving_id, row_pos, <39 text columns>)``.

    One row per item; header values stand on the first row only; a document without items has one row.
    Cells of the accounting system and of manual corrections stay blank. ``lines`` are the stored
    metadata lines that pair with items by position.
    """
    heads = register_headers(receivings, documents, headers, document_totals(items, lines))
    meta = lines.select(
        "receiving_id", "item_pos",
        *[(F.col(c) if c in lines.columns else F.lit(None)).cast(k).alias("m_" + c)
          for c, k in (("sum", "double"), ("vat", "string"), ("vat_percent", "double"), ("vat_sum", "double"))],
    )
    quantity, price = F.coalesce("received_quantity", F.lit(0.0)), F.coalesce("invoice_price", F.lit(0.0))
    total = line_sum_or_default(F.col("m_sum"), quantity, price)
    cells = items.join(meta, ["receiving_id", "item_pos"], "left").select(
        "receiving_id",
        F.col("item_pos").alias("row_pos"),
        F.coalesce(F.nullif("item_name_from_invoice", F.lit("")), "item_name_from_order").alias("name"),
        "unit",
        float_text(quantity).alias("quantity"),
        float_text(price).alias("price"),
        float_text(total).alias("line_sum"),
        vat_display(F.col("m_vat"), F.col("m_vat_percent"), F.col("comment")).alias("vat"),
        float_text(F.col("m_vat_sum")).alias("vat_sum"),
        float_text(gross_sum(total, F.col("m_vat_sum"))).alias("line_sum_with_vat"),
    )
    # the first position carries the header; found by a map-side combined minimum, not by a window
    firsts = cells.groupBy("receiving_id").agg(F.min("row_pos").alias("first_pos"))
    joined = heads.join(firsts, "receiving_id", "left").join(cells, "receiving_id", "left")
    leading = F.col("row_pos").isNull() | (F.col("row_pos") == F.col("first_pos"))

    def cell(header: str) -> Column:
        if header in HEADER_CELLS:
            value = F.when(leading, F.col(HEADER_CELLS[header]))
        elif header in ITEM_CELLS:
            value = F.col(ITEM_CELLS[header])
        elif header == "Дубль":
            value = F.col("duplicate_indicator")
        else:
            value = F.lit("")
        return F.coalesce(value.cast("string"), F.lit("")).alias(header)

    return joined.select(
        "receiving_id", F.coalesce("row_pos", F.lit(1)).cast("long").alias("row_pos"), *[cell(h) for h in REGISTER_HEADERS]
    )


# ---------------------------------------------------------------- document ids and merge

def parse_document_id(cell: Column | str) -> Column:
    """Register id cell as number: digits only, or a whole floating number."""
    text = F.trim((F.col(cell) if isinstance(cell, str) else cell).cast("string"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("long")).when(
        text.rlike(r"^\d+\.0+$"), text.try_cast("double").try_cast("long")
    )


def next_document_id(register: DataFrame, legacy_column: str = "Корректировка") -> DataFrame:
    """One row ``next_id``: one above every id of the current and the legacy id column, 1 if there are none."""
    columns = [c for c in ("ID документа", legacy_column) if c in register.columns]
    largest = F.greatest(F.lit(0), *[F.coalesce(parse_document_id(c), F.lit(0)) for c in columns])
    return register.agg((F.coalesce(F.max(largest), F.lit(0)) + 1).alias("next_id"))


def number_documents(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New register rows with document ids above the existing ones, on each document's first row.

    Ids follow the order of ``receiving_id``. Documents are dealt into ranges of like size, however sparse their
    ids, ranked inside their range and shifted by the counts of the ranges before. Only the table of ranges, a row for
    each partition, is ordered as a whole. The ranges are sampled, so they are fixed by a checkpoint.
    """
    ensure_checkpoint_dir(new.sparkSession)
    documents = (
        new.groupBy("receiving_id")
        .agg(F.min("row_pos").alias("_first"))
        .repartitionByRange("receiving_id")
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    ranked = documents.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_range").orderBy("receiving_id"))
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        documents.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.lit(1).alias("_one"))
        .join(next_document_id(existing).withColumn("_one", F.lit(1)), "_one")
    )
    numbered = ranked.join(offsets, "_range").select(
        "receiving_id", "_first", (F.col("next_id") + F.col("_before") + F.col("_rank") - 1).alias("document_id")
    )
    return (
        new.join(numbered, "receiving_id")
        .withColumn(
            "ID документа",
            F.when(F.col("row_pos") == F.col("_first"), F.col("document_id").cast("string")).otherwise(F.lit("")),
        )
        .drop("_first")
    )


def merge_register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New documents ahead of the existing rows.

    Both sides carry ``row_pos``; the result carries ``merged_block`` (0 for new, 1 for existing) and keeps the document
    id of new rows, so ``orderBy(merged_block, document_id desc, row_pos)`` is the reading order.
    """
    numbered = number_documents(new, existing).withColumn("merged_block", F.lit(0))
    kept = existing.withColumns({"merged_block": F.lit(1), "document_id": F.lit(None).cast("long")})
    return numbered.unionByName(kept, allowMissingColumns=True)


def write_register(register: DataFrame, path: str, folders: int = 256) -> None:
    """CSV files of the receiving id and the 39 columns, in ``folders`` folders by a hash of the receiving id.

    The rows of a document stand together in one file, in row order.
    """
    rows = register.withColumn("folder", F.pmod(F.xxhash64("receiving_id"), F.lit(folders)))
    rows.repartition("folder").sortWithinPartitions("folder", "receiving_id", "row_pos").select(
        "folder", "receiving_id", *[F.col(f"`{title}`") for title in REGISTER_HEADERS]
    ).write.mode("overwrite").partitionBy("folder").option("header", True).option("emptyValue", "").csv(path)
