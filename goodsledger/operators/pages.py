"""Pages of one document merged into one header and one run of items.

Nothing is gathered per document: header fields are map-side combined minima by page, items and page texts stay
rows in page order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goodsledger.functions.arrays import exploded
from goodsledger.operators.extract import HEADER_COLUMNS

NOTE_MERGED = "Многостраничная накладная: объединено файлов/страниц: "


def merge_headers(pages: DataFrame) -> DataFrame:
    """``(doc_id, n_pages, <header fields>)``: each field from the first page that has it.

    The total is dropped when there are several pages and any item: it is then computed from all items.
    """
    types = {f.name: f.dataType for f in pages.schema.fields}

    def first_given(name: str) -> Column:
        value = F.col(name)
        given = value.isNotNull() & (value != "") if isinstance(types[name], T.StringType) else value.isNotNull()
        return F.min_by(value, F.when(given, F.col("page"))).alias(name)

    fields = [c for c in HEADER_COLUMNS if c in types]
    merged = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum(F.size("items")).alias("n_items"),
        *[first_given(c) for c in fields],
    )
    dropped = (F.col("n_pages") > 1) & (F.col("n_items") > 0)
    return merged.withColumn("total_sum", F.when(~dropped, F.col("total_sum")))


def merge_items(pages: DataFrame) -> DataFrame:
    """Items of all pages in page order: ``(doc_id, page, item_pos, <item fields>)``.

    ``item_pos`` runs through the document: the position on the page plus the items of the pages before. The
    offsets are a running sum over page rows (one small row per page).
    """
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pages.select("doc_id", "page", F.size("items").alias("n")).select(
        "doc_id", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")
    )
    rows = exploded(pages, F.col("items"), "at", "item", "doc_id", "page")
    return rows.join(offsets, ["doc_id", "page"]).select(
        "doc_id", "page", (F.col("skip") + F.col("at") + 1).alias("item_pos"), "item.*"
    )


def merge_texts(pages: DataFrame) -> DataFrame:
    """Raw texts under page titles, ``(doc_id, page, raw_text)``; in page order, joined by a blank line, the document's."""
    tagged = F.concat(
        F.lit("--- File "), F.col("page").cast("string"), F.lit(": "), F.col("file_name"), F.lit(" ---\n"),
        F.coalesce("text", F.lit("")),
    )
    return pages.select("doc_id", "page", tagged.alias("raw_text"))


def merge_notes(pages: DataFrame) -> DataFrame:
    """Distinct parser notes in first-seen order: ``(doc_id, note_pos, note)``; merged documents say so first."""
    seen = (
        exploded(pages, F.col("parser_notes"), "at", "note", "doc_id", "page")
        .where(F.coalesce("note", F.lit("")) != "")
        .groupBy("doc_id", "note")
        .agg(F.min(F.struct("page", "at")).alias("first"))
        .select("doc_id", F.col("first.page").cast("long").alias("page"), F.col("first.at").alias("at"), "note")
    )
    several = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    intro = several.select(
        "doc_id", F.lit(0).cast("long").alias("page"), F.lit(0).alias("at"),
        F.concat(F.lit(NOTE_MERGED), F.col("n").cast("string"), F.lit(".")).alias("note"),
    )
    return seen.unionByName(intro)


def merge_providers(pages: DataFrame) -> DataFrame:
    """Provider mark per document: the only one, or all distinct ones in first-seen order."""
    firsts = (
        pages.where(F.coalesce("parser_provider", F.lit("")) != "")
        .groupBy("doc_id", "parser_provider")
        .agg(F.min("page").alias("page"))
    )
    # a handful of distinct marks per document
    joined = firsts.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page", "parser_provider"))), lambda x: x["parser_provider"]).alias("marks")
    )
    return joined.select(
        "doc_id",
        F.when(F.size("marks") == 1, F.element_at("marks", 1))
        .otherwise(F.concat(F.lit("multipage_"), F.array_join("marks", "+")))
        .alias("parser_provider"),
    )
