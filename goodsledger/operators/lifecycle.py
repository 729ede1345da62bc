"""Receiving life cycle: open, attach documents, compare, correct, confirm.

Every transform is a function of DataFrames. Rows of one receiving meet on ``receiving_id``; all
roll-ups are map-side combined, so a receiving with very many lines costs one small partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.functions.arrays import exploded
from goodsledger.functions.similarity import normalized_similarity
from goodsledger.functions.text import as_col, normalize_product_name
from goodsledger.operators.candidates import containing, similar_names
from goodsledger.operators.matching import FOLD_LIMIT, REPLACEMENT_THRESHOLD, match_lines
from goodsledger.schemas import CONFIRMED_STATUSES
from goodsledger.session import ensure_checkpoint_dir, stored

SUPPLIER_THRESHOLD = 0.35
# Comment texts.
SUPPLIER_MISMATCH_PREFIX = "Поставщик в накладной отличается от поставщика в заявке: "
SUPPLIER_MISMATCH_MARKER = "Поставщик в накладной отличается"
COMMENT_ACCEPTED_EXTRA = "Принято как дополнительная позиция"


# ---------------------------------------------------------------- opening and documents

def open_receivings(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with nested ``order_items`` to receivings and positioned ordered lines.

    ``requests`` carries ``receiving_id`` (assigned upstream); blank units become pieces, absent prices 0.
    """
    receivings = requests.drop("order_items").withColumnRenamed("receiving_id", "id").withColumn(
        "status", F.lit("receiving_started")
    ).withColumn("comment", F.lit(None).cast("string"))
    lines = exploded(requests, F.col("order_items"), "pos", "item", "receiving_id")
    fields = {f.name for f in requests.schema["order_items"].dataType.elementType.fields}

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.col("item")[name], default) if name in fields else default

    return receivings, lines.select(
        "receiving_id",
        (F.col("pos") + 1).alias("item_pos"),
        F.col("item")["name"].alias("name"),
        F.col("item")["quantity"].cast("double").alias("quantity"),
        field("unit", F.lit("шт")).alias("unit"),
        field("price", F.lit(0.0)).cast("double").alias("price"),
        field("supplier_product_id", F.lit(None).cast("string")).alias("supplier_product_id"),
        field("role", F.lit(None).cast("string")).alias("role"),
    )


def attach_documents(receivings: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents: OCR status by presence of text; the receiving follows its newest document."""
    has_text = F.coalesce(F.col("raw_text"), F.lit("")) != ""
    stored = documents.withColumn(
        "ocr_status", F.when(has_text, "ocr_processed").otherwise("uploaded")
    )
    newest = latest_documents(stored).select(
        F.col("receiving_id").alias("id"),
        F.when(F.col("ocr_status") == "ocr_processed", "ocr_processed")
        .otherwise("documents_uploaded")
        .alias("new_status"),
    )
    updated = (
        receivings.join(newest, "id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .drop("new_status")
    )
    return updated, stored


def latest_documents(documents: DataFrame) -> DataFrame:
    """The newest document of every receiving, as one map-side combined aggregate."""
    payload = [c for c in documents.columns if c != "receiving_id"]
    newest = F.max_by(F.struct(*payload), F.col("id")).alias("doc")
    return documents.groupBy("receiving_id").agg(newest).select("receiving_id", "doc.*")


# ---------------------------------------------------------------- compare

def rollup_status(receivings: DataFrame, items: DataFrame) -> DataFrame:
    """Receiving status from its item statuses; a receiving without items counts as fully matched."""
    flags = items.groupBy(F.col("receiving_id").alias("id")).agg(
        F.bool_or(F.col("status") == "extra").alias("any_extra"),
        F.bool_or(F.col("status") == "missing").alias("any_missing"),
        F.bool_and(F.col("status") == "matched").alias("all_matched"),
    )
    status = (
        F.when(F.col("any_extra"), "has_extra_items")
        .when(F.col("any_missing"), "matched_partial")
        .when(F.coalesce("all_matched", F.lit(True)), "matched_full")
        .otherwise("requires_correction")
    )
    return (
        receivings.join(flags, "id", "left")
        .withColumn("status", status)
        .drop("any_extra", "any_missing", "all_matched")
    )


def supplier_differs(ordered: Column | str, invoiced: Column | str) -> Column:
    """True when neither name contains the other and the similarity stays under 0.35."""
    expected, actual = normalize_product_name(as_col(ordered)), normalize_product_name(as_col(invoiced))
    # the measure normalizes its arguments again
    again = normalized_similarity(normalize_product_name(expected), normalize_product_name(actual))
    given = F.coalesce(as_col(invoiced), F.lit("")) != ""
    return given & ~(actual.contains(expected) | expected.contains(actual)) & (again < SUPPLIER_THRESHOLD)


def mark_supplier_mismatch(receivings: DataFrame, invoice_supplier: Column | str) -> DataFrame:
    """Receivings whose invoice names another supplier require correction; runs after the roll-up."""
    differs = supplier_differs("supplier", invoice_supplier)
    return receivings.withColumns(
        {
            "status": F.when(differs, "requires_correction").otherwise(F.col("status")),
            "comment": F.when(
                differs, F.concat(F.lit(SUPPLIER_MISMATCH_PREFIX), as_col(invoice_supplier))
            ).otherwise(F.col("comment")),
        }
    )


def compare_invoices(
    receivings: DataFrame,
    order_lines: DataFrame,
    invoice_headers: DataFrame,
    invoice_lines: DataFrame,
    documents: DataFrame | None = None,
    fold_limit: int = FOLD_LIMIT,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Compare invoices with orders: (receivings, items, documents) after the comparison.

    ``invoice_headers(receiving_id, invoice_number, invoice_date, supplier_legal_name)``: one row per compared
    receiving. Other receivings pass through unchanged; items are those of the compared receivings, written once.
    """
    heads = invoice_headers.select("receiving_id", F.col("supplier_legal_name").alias("new_supplier"))
    found = match_lines(
        order_lines.join(heads.select("receiving_id"), "receiving_id", "left_semi"), invoice_lines, fold_limit
    )
    # the roll-up and whoever reads the items would each match again
    items = stored(found, "items")
    compared = receivings.join(
        heads.select(F.col("receiving_id").alias("id"), "new_supplier"), "id"
    )
    others = receivings.join(heads.select(F.col("receiving_id").alias("id")), "id", "left_anti")
    after = mark_supplier_mismatch(rollup_status(compared, items), "new_supplier").drop("new_supplier")
    return after.unionByName(others), items, None if documents is None else patch_documents(documents, invoice_headers)


def patch_documents(documents: DataFrame, invoice_headers: DataFrame) -> DataFrame:
    """The newest document of every compared receiving takes the values of the invoice's header."""
    heads = invoice_headers.select(
        "receiving_id",
        F.col("invoice_number").alias("new_number"),
        F.col("invoice_date").alias("new_date"),
        F.col("supplier_legal_name").alias("new_supplier"),
    )
    newest = documents.groupBy("receiving_id").agg(F.max("id").alias("newest_id"))
    joined = documents.join(newest.join(heads, "receiving_id"), "receiving_id", "left")
    hit = F.col("id") == F.col("newest_id")

    def patched(new: str, old: str) -> Column:
        return F.when(hit, F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))).otherwise(F.col(old))

    return joined.withColumns(
        {
            "invoice_number": patched("new_number", "invoice_number"),
            "invoice_date": patched("new_date", "invoice_date"),
            "supplier_legal_name": patched("new_supplier", "supplier_legal_name"),
            "ocr_status": F.when(hit, "ocr_processed").otherwise(F.col("ocr_status")),
        }
    ).select(*documents.columns)


def compare_summary(items: DataFrame) -> DataFrame:
    """Counts by outcome per receiving."""

    def count(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return items.groupBy("receiving_id").agg(
        count("matched").alias("matched"),
        count("missing").alias("missing"),
        count("extra").alias("extra"),
        count("quantity_mismatch").alias("quantity_mismatch"),
        count("price_mismatch").alias("price_mismatch"),
        count("manual_review", "replacement_candidate", "crossed_out").alias("manual_review"),
    )


# ---------------------------------------------------------------- corrections

#: Texts times names of a receiving from which on the names are found through indexes.
INDEXED_PAIRS = 20_000


def _best_items(probes: DataFrame, items: DataFrame, indexed_pairs: int) -> DataFrame:
    """``(receiving_id, query_norm, item_pos)`` of the item each text means, where one fits.

    A receiving with few texts and names compares them as they are. Where they are many, containment is found by the
    text's rarest piece and similarity by rare tokens (``candidates.py``); both ways give the same rows. Names are
    classes of equal texts with their first and last position, and a maximum per text is formed on the map side.
    Texts and names are written first, so the match behind the items runs once for all of this.
    """
    told = F.explode(F.array(normalize_product_name("item_name_from_order"), normalize_product_name("item_name_from_invoice")))
    asked = probes.select("receiving_id").distinct()
    names = (
        items.join(asked, "receiving_id", "left_semi").select("receiving_id", "item_pos", told.alias("norm"))
        .groupBy("receiving_id", "norm").agg(F.min("item_pos").alias("first_pos"), F.max("item_pos").alias("last_pos"))
    )
    ensure_checkpoint_dir(items.sparkSession)
    probes = probes.withColumn("again", normalize_product_name("query_norm")).checkpoint()
    names = names.withColumn("again", normalize_product_name("norm")).checkpoint()

    def size(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("receiving_id").agg(F.count(F.lit(1)).alias(name))

    crowded = size(probes, "texts").join(size(names, "names"), "receiving_id").where(
        F.col("texts") * F.col("names") > indexed_pairs
    ).select("receiving_id").checkpoint()

    def rank(direct: Column, score: Column) -> Column:
        place = F.when(direct, F.col("last_pos")).otherwise(-F.col("first_pos"))
        return F.struct(direct.alias("direct"), F.when(direct, F.lit(1.0)).otherwise(score).alias("score"), place.alias("place"))

    def leaders(found: DataFrame) -> DataFrame:
        best = found.groupBy("receiving_id", "query_norm").agg(F.max("rank").alias("best")).where(F.col("best.score") >= REPLACEMENT_THRESHOLD)
        return best.select("receiving_id", "query_norm", F.abs("best.place").alias("item_pos"))

    few = probes.join(crowded, "receiving_id", "left_anti").withColumnRenamed("again", "query_again")
    paired = few.join(names, "receiving_id")
    score = normalized_similarity(F.col("query_again"), F.col("again"))
    compared = paired.select("receiving_id", "query_norm", rank(F.col("norm").contains(F.col("query_norm")), score).alias("rank"))
    if crowded.isEmpty():
        return leaders(compared)

    texts, many = (side.join(crowded, "receiving_id", "left_semi") for side in (probes, names))
    first_last = many.drop("again").withColumnRenamed("norm", "right")
    direct = containing(texts.select("receiving_id", F.col("query_norm").alias("norm")), many.select("receiving_id", "norm"))
    direct = direct.join(first_last, ["receiving_id", "right"]).select("receiving_id", F.col("left").alias("query_norm"), rank(F.lit(True), F.lit(1.0)).alias("rank"))
    # an empty text lies in every name
    last = many.groupBy("receiving_id").agg(F.max("last_pos").alias("last_pos"), F.min("first_pos").alias("first_pos"))
    empty = texts.where(F.col("query_norm") == "").join(last, "receiving_id").select("receiving_id", "query_norm", rank(F.lit(True), F.lit(1.0)).alias("rank"))
    sides = [side.select("receiving_id", F.col("again").alias("norm")).distinct() for side in (texts, many)]
    places = many.groupBy("receiving_id", F.col("again").alias("right")).agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
    close = similar_names(*sides, REPLACEMENT_THRESHOLD)
    ranked = close.join(places, ["receiving_id", "right"]).select("receiving_id", F.col("left").alias("again"), rank(F.lit(False), F.col("score")).alias("rank"))
    similar = texts.join(ranked, ["receiving_id", "again"]).select("receiving_id", "query_norm", "rank")

    return leaders(reduce(DataFrame.unionByName, [compared, direct, empty, similar]))


def locate_corrections(corrections: DataFrame, items: DataFrame, indexed_pairs: int = INDEXED_PAIRS) -> DataFrame:
    """The item every correction refers to: ``(receiving_id, seq, …, item_pos)``, null where none fits.

    By id when one is given (no fallback to the text). By text otherwise: names containing the text beat
    scores and the last of them wins; else the best similarity wins, the first on ties, from 0.25 up.
    ``item_id`` refers to ``item_pos`` of the receiving. No candidate list is gathered, whatever the size of a
    receiving (``_best_items``).
    """
    keyed = corrections.withColumn("query_norm", normalize_product_name("item_query"))
    by_id = (
        keyed.where(F.col("item_id").isNotNull())
        .join(
            items.select("receiving_id", F.col("item_pos").alias("item_id"), "item_pos"),
            ["receiving_id", "item_id"],
            "left",
        )
        .drop("query_norm")
    )
    by_text = keyed.where(F.col("item_id").isNull() & (F.coalesce("item_query", F.lit("")) != ""))
    best = _best_items(by_text.select("receiving_id", "query_norm").distinct(), items, indexed_pairs)
    found = by_text.join(best, ["receiving_id", "query_norm"], "left").drop("query_norm")
    nowhere = keyed.where(
        F.col("item_id").isNull() & (F.coalesce("item_query", F.lit("")) == "")
    ).drop("query_norm").withColumn("item_pos", F.lit(None).cast("long"))
    return by_id.unionByName(found).unionByName(nowhere)


def apply_corrections(
    receivings: DataFrame, items: DataFrame, corrections: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Corrections in ``seq`` order, then the status roll-up of the corrected receivings.

    The lookup reads names only and no action changes a name, so per item only the last status, the last
    quantity, the last price and the last comment survive: four map-side combined ``max_by``.
    """
    action, quantity, price = F.col("action"), F.col("quantity"), F.col("price")
    accepted = (
        (action == "mark_received")
        | ((action == "set_quantity") & quantity.isNotNull())
        | ((action == "set_price") & price.isNotNull())
    )
    status = (
        F.when(accepted, "accepted")
        .when(action == "reject", "rejected")
        .when(action == "accept_extra", "extra_accepted")
        .when(action == "mark_crossed_out", "crossed_out")
        .otherwise("manual_review")
    )
    said = F.nullif(F.col("comment"), F.lit(""))
    effects = (
        locate_corrections(corrections, items)
        .where(F.col("item_pos").isNotNull())
        .select(
            "receiving_id",
            "item_pos",
            "seq",
            status.alias("new_status"),
            F.when(action.isin("mark_received", "set_quantity", "accept_extra"), quantity).alias("new_quantity"),
            F.when(action == "set_price", price).alias("new_price"),
            F.coalesce(said, F.when(action == "accept_extra", F.lit(COMMENT_ACCEPTED_EXTRA))).alias("new_comment"),
        )
    )

    def last(name: str) -> Column:
        # max_by ignores rows whose ordering key is null, so rows without a value drop out
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    folded = effects.groupBy("receiving_id", "item_pos").agg(
        last("new_status"), last("new_quantity"), last("new_price"), last("new_comment")
    )
    corrected = (
        items.join(folded, ["receiving_id", "item_pos"], "left")
        .withColumns(
            {
                "status": F.coalesce("new_status", "status"),
                "received_quantity": F.coalesce("new_quantity", "received_quantity"),
                "invoice_price": F.coalesce("new_price", "invoice_price"),
                "comment": F.coalesce("new_comment", "comment"),
            }
        )
        .select(*items.columns)
    )
    touched = corrections.select(F.col("receiving_id").alias("id")).distinct()
    rolled = rollup_status(receivings.join(touched, "id", "left_semi"), corrected)
    return rolled.unionByName(receivings.join(touched, "id", "left_anti")), corrected


# ---------------------------------------------------------------- confirmation and gate

def confirm_receivings(receivings: DataFrame, confirmations: DataFrame) -> DataFrame:
    """``confirmations(receiving_id, confirmed, partial, comment)``; the comment is replaced."""
    verdict = confirmations.select(
        F.col("receiving_id").alias("id"),
        F.when(F.col("confirmed") & F.col("partial"), "confirmed_partial")
        .when(F.col("confirmed"), "confirmed_full")
        .otherwise("control_required")
        .alias("verdict"),
        F.col("comment").alias("verdict_comment"),
    )
    return (
        receivings.join(verdict, "id", "left")
        .withColumns(
            {
                "comment": F.when(F.col("verdict").isNotNull(), F.col("verdict_comment")).otherwise(F.col("comment")),
                "status": F.coalesce("verdict", "status"),
            }
        )
        .drop("verdict", "verdict_comment")
    )


def send_gate(receivings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receivings that may be sent to accounting, and those that may not."""
    confirmed = F.col("status").isin(*CONFIRMED_STATUSES)
    reason = F.lit("Передача в учетную систему возможна только после подтверждения приемки")
    return receivings.where(confirmed), receivings.where(~confirmed).withColumn("error_message", reason)
