"""Free correction texts to structured corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goodsledger.functions.numbers import to_double
from goodsledger.functions.text import any_of, as_col, squeeze, strip_chars

# Number words; when several occur the last of this order counts.
NUMBER_WORDS = (
    ("ноль", 0),
    ("один", 1),
    ("одна", 1),
    ("одно", 1),
    ("два", 2),
    ("две", 2),
    ("три", 3),
    ("четыре", 4),
    ("пять", 5),
    ("шесть", 6),
    ("семь", 7),
    ("восемь", 8),
    ("девять", 9),
    ("десять", 10),
)
# Words that decide the action.
REJECT_WORDS = ("не принимать", "отклонить", "отменить товар", "не было")
CROSSED_OUT_WORDS = ("зачерк", "вычерк")
EXTRA_WORDS = ("лишн", "дополнительн", "принять как дополнитель")
PRICE_WORDS = ("цена", "стоимость", "руб")
# Texts taken out, in this order, to leave the item query.
QUERY_NOISE = (
    r"есть в накладной",
    r"пришло",
    r"пришел",
    r"пришла",
    r"принять",
    r"не принимать",
    r"отклонить",
    r"количество",
    r"цена",
    r"стоимость",
    r"(?U)строка\s*\d+",
    r"(?U)\d+(?:[,.]\d+)?\s*(?:шт|штук|кг|л|уп|короб|ед|руб|₽)?",
)


def _number(text: Column) -> Column:
    return to_double(F.translate(text, ",", "."))


def correction_quantity(low: Column) -> Column:
    written = _number(F.regexp_extract(low, r"(\d+(?:[,.]\d+)?)", 1))
    worded = None
    for word, value in reversed(NUMBER_WORDS):
        test = low.rlike(rf"(?U)\b{word}\b")
        worded = F.when(test, F.lit(float(value))) if worded is None else worded.when(test, F.lit(float(value)))
    return F.coalesce(written, worded)


def correction_price(low: Column) -> Column:
    return _number(F.regexp_extract(low, r"(?U)(?:цена|стоимость|по)\s*(\d+(?:[,.]\d+)?)", 1))


def correction_query(low: Column) -> Column:
    for pattern in QUERY_NOISE:
        low = F.regexp_replace(low, pattern, " ")
    return F.nullif(strip_chars(squeeze(low), " .,:;—-"), F.lit(""))


def parse_correction(text: Column | str) -> Column:
    """struct(item_query, action, quantity, price, comment) of a free text."""
    text = as_col(text)
    low = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    quantity, price = correction_quantity(low), correction_price(low)
    action = (
        F.when(any_of(low, REJECT_WORDS), "reject")
        .when(any_of(low, CROSSED_OUT_WORDS), "mark_crossed_out")
        .when(any_of(low, EXTRA_WORDS), "accept_extra")
        .when(price.isNotNull() & any_of(low, PRICE_WORDS), "set_price")
        .when(quantity.isNotNull(), "set_quantity")
        .otherwise("mark_received")
    )
    return F.struct(
        correction_query(low).alias("item_query"), action.alias("action"), quantity.alias("quantity"),
        price.alias("price"), text.alias("comment"),
    )
