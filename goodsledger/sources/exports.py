"""CSV export of receivings, items and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goodsledger.operators.history import _iso

# Column titles of the three files.
RECEIVING_TITLES = (
    "Дата создания", "Дата изменения", "ID приемки", "ID заявки", "Номер заявки", "Заведение", "Поставщик", "Chat ID",
    "User ID", "Статус приемки", "Кол-во товаров в заявке", "Кол-во совпавших", "Кол-во не найденных", "Кол-во лишних",
    "Комментарий", "Ссылки на накладные",
)
ITEM_TITLES = (
    "ID приемки", "ID заявки", "Товар из заявки", "Товар из накладной", "Заказано", "Принято", "Ед. изм.",
    "Цена в заявке", "Цена в накладной", "Статус позиции", "Комментарий",
)
DOCUMENT_TITLES = (
    "ID приемки", "ID заявки", "Тип файла", "File ID MAX", "Ссылка на файл", "Статус OCR", "Юр. название поставщика",
    "Номер накладной", "Дата накладной", "Raw text OCR",
)


def export_tables(
    receivings: DataFrame, order_lines: DataFrame, items: DataFrame, documents: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three export tables, titled. Counts are pre-aggregated per receiving before they meet it."""
    def status(name: str):
        return F.count_if(F.col("status") == name).alias("n_" + name)

    ordered = order_lines.groupBy(F.col("receiving_id").alias("id")).agg(F.count(F.lit(1)).alias("n_ordered"))
    counts = items.groupBy(F.col("receiving_id").alias("id")).agg(status("matched"), status("missing"), status("extra"))
    link = F.coalesce(F.nullif("file_url", F.lit("")), F.nullif("file_id", F.lit("")), F.lit(""))
    # the cell with all links of a receiving is one cell of the file, whatever its size
    linked = documents.select("receiving_id", "id", link.alias("link"))
    links = (
        linked.groupBy("receiving_id")
        .agg(F.array_sort(F.collect_list(F.struct("id", "link"))).alias("all"))
        .select(F.col("receiving_id").alias("id"), F.to_json(F.transform("all", lambda x: x["link"])).alias("links"))
    )
    zero = F.lit(0)
    head = (
        receivings.join(ordered, "id", "left").join(counts, "id", "left").join(links, "id", "left")
    )
    have = set(receivings.columns)

    def column(name: str):
        return F.col(name) if name in have else F.lit(None).cast("string")

    first = head.select(
        *[c.alias(t) for c, t in zip(
            (
                _iso("created_at"), _iso("updated_at" if "updated_at" in have else "created_at"), F.col("id"),
                F.col("request_id"), F.col("order_number"), F.col("venue"), F.col("supplier"), column("chat_id"),
                column("user_id"), F.col("status"), F.coalesce("n_ordered", zero), F.coalesce("n_matched", zero),
                F.coalesce("n_missing", zero), F.coalesce("n_extra", zero), F.col("comment"),
                F.coalesce("links", F.lit("[]")),
            ),
            RECEIVING_TITLES,
        )]
    )
    requests = receivings.select(F.col("id").alias("receiving_id"), "request_id")
    # rows whose receiving is gone stay, without a request
    request = F.coalesce("request_id", F.lit(""))
    second = items.join(requests, "receiving_id", "left").withColumn("request_id", request).select(
        *[F.col(c).alias(t) for c, t in zip(
            (
                "receiving_id", "request_id", "item_name_from_order", "item_name_from_invoice", "ordered_quantity",
                "received_quantity", "unit", "ordered_price", "invoice_price", "status", "comment",
            ),
            ITEM_TITLES,
        )]
    )
    third = documents.join(requests, "receiving_id", "left").withColumn("request_id", request).select(
        *[F.col(c).alias(t) for c, t in zip(
            (
                "receiving_id", "request_id", "file_type", "file_id", "file_url", "ocr_status", "supplier_legal_name",
                "invoice_number", "invoice_date", "raw_text",
            ),
            DOCUMENT_TITLES,
        )]
    )
    return first, second, third


def export_receiving_csv(
    receivings: DataFrame, order_lines: DataFrame, items: DataFrame, documents: DataFrame, folder: str
) -> dict[str, str]:
    """Write the three tables as CSV folders and name them."""
    names = ("receivings", "items", "documents")
    paths = {name: f"{folder}/{name}" for name in names}
    for name, df in zip(names, export_tables(receivings, order_lines, items, documents)):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(paths[name])
    return paths
