"""Lists: document history, exports, mappings, latest sheet exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_record(documents: DataFrame) -> DataFrame:
    """Documents as twelve columns with ISO times."""
    return documents.select(
        "id", "receiving_id", "file_id", "file_type", "source", "file_url", "ocr_status", "supplier_legal_name",
        "invoice_number", "invoice_date", "raw_text", _iso("created_at").alias("created_at"),
    )


def _iso(name: str) -> Column:
    return F.regexp_replace(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def document_history(
    documents: DataFrame, receivings: DataFrame, supplier: str | None = None, venue: str | None = None
) -> DataFrame:
    """Documents of all (or one supplier's, or one venue's) receivings, newest first."""
    wanted = receivings
    if supplier:
        wanted = wanted.where(F.col("supplier") == supplier)
    if venue:
        wanted = wanted.where(F.col("venue") == venue)
    found = documents.join(wanted.select(F.col("id").alias("receiving_id")), "receiving_id", "left_semi")
    return document_record(found.orderBy(F.col("created_at").desc(), F.col("id").desc()))


def export_list(exports: DataFrame, target_system: str | None = None) -> DataFrame:
    """Exports, newest first; optionally of one target system."""
    rows = exports if target_system is None else exports.where(F.col("target_system") == target_system)
    return rows.orderBy(F.col("id").desc()).select(
        "id", "receiving_id", "request_id", "order_number", "status", "error_message", "created_at"
    )


def mapping_list(mappings: DataFrame, venue: str | None = None) -> DataFrame:
    """Stored name mappings, newest first."""
    rows = mappings.where(F.col("venue") == venue) if venue else mappings
    return rows.orderBy(F.col("id").desc())


def append_mappings(mappings: DataFrame, path: str) -> None:
    mappings.write.mode("append").parquet(path)


_SHEET_FIELDS = (
    "spreadsheet_id", "spreadsheet_url", "spreadsheet_name", "sheet_name", "data_start_row", "data_end_row", "data_range",
)


def latest_sheets(exports: DataFrame) -> DataFrame:
    """Newest sheet export per receiving, its payload fields as columns; a map-side combined maximum."""
    newest = (
        exports.where(F.col("target_system") == "google_sheets")
        .groupBy("receiving_id")
        .agg(F.max_by("payload_json", "id").alias("payload_json"), F.max("id").alias("export_id"))
    )
    return newest.select(
        "receiving_id", "export_id", *[F.get_json_object("payload_json", f"$.{f}").alias(f) for f in _SHEET_FIELDS]
    ).where(F.coalesce("spreadsheet_id", F.lit("")) != "")


def reusable_sheet(exports: DataFrame, recent: int = 20) -> DataFrame:
    """The newest usable spreadsheet id among the most recent sheet exports; one row or none."""
    last = exports.where(F.col("target_system") == "google_sheets").orderBy(F.col("id").desc()).limit(recent)
    ids = last.select("id", F.get_json_object("payload_json", "$.spreadsheet_id").alias("spreadsheet_id"))
    return ids.where(F.coalesce("spreadsheet_id", F.lit("")) != "").orderBy(F.col("id").desc()).limit(1)
