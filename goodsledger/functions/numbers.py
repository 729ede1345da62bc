"""Numbers, sums, VAT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goodsledger.functions.text import as_col, blank_to_null, first_match, let, strip_chars

NUMBER_RE = r"(\d{1,3}(?:\s\d{3})+(?:[,.]\d+)?%?|\d+(?:[,.]\d+)?%?)"
PERCENT_RE = r"(?U)(?<!\d)(\d{1,2}(?:[,.]\d+)?)\s*%"
_PLAIN_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_WHOLE_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"

# VAT rates a computed percent snaps to, and the snapping distance.
VAT_RATES = (0, 10, 18, 20)
VAT_SNAP = 0.6

# Classifier codes of the piece unit.
PIECE_CODES = (166, 796)


def to_double(clean: Column) -> Column:
    return first_match(clean, _PLAIN_FLOAT).try_cast("double")


def small_int(text: Column) -> Column:
    """Up to nine plain digits as int, else null. A failing cast would raise and catch an error for each text."""
    return first_match(text, r"^[0-9]{1,9}$").try_cast("int")


def ocr_number(value: Column | str) -> Column:
    """Recognized number: separators, apostrophes and percent signs dropped, comma as point."""
    clean = F.replace(as_col(value), F.lit(","), F.lit("."))
    for char in "\u00a0' %":
        clean = F.replace(clean, F.lit(char))
    return to_double(clean)


def sheet_number(value: Column | str) -> Column:
    """Sheet cell as double; blank or malformed cells are null. Only cells that hold other blanks are trimmed first."""
    clean = F.translate(as_col(value).cast("string"), ",\u00a0 %", ".")
    trimmed = F.when(clean.rlike(r"(?U)\s"), to_double(blank_to_null(clean)))
    return F.when(clean.rlike(_WHOLE_FLOAT), clean.try_cast("double")).otherwise(trimmed)


def sheet_int(value: Column | str) -> Column:
    return sheet_number(value).try_cast("int")


def decimal_or_null(value: Column | str) -> Column:
    clean = F.translate(as_col(value).cast("string"), ", ", ".")
    return F.nullif(F.regexp_extract(clean, _PLAIN_FLOAT, 0), F.lit("")).try_cast("decimal(24,6)")


def round_even(value: Column, digits: int = 2) -> Column:
    """Half-even rounding of the shortest decimal form of a double."""
    return F.bround(value.cast("decimal(38,10)"), digits).cast("double")


def parse_vat_percent(text: Column | str) -> Column:
    return to_double(blank_to_null(F.translate(as_col(text), ",%", ".")))


def vat_text_from_comment(comment: Column | str) -> Column:
    """VAT noted in a row comment, as text: the first part naming it decides; blank when none does."""
    parts = F.filter(
        F.split(F.coalesce(as_col(comment), F.lit("")), ";"),
        lambda p: p.contains("vatPercent") | p.contains("НДС"),
    )
    first = F.get(parts, F.lit(0))
    noted = F.trim(F.regexp_extract(first, r"^[^:]*:(.*)$", 1))
    named = parse_vat_percent(F.trim(F.replace(first, F.lit("НДС:"), F.lit(""))))
    return F.when(first.contains("vatPercent"), noted).otherwise(F.coalesce(float_text(named), F.lit("")))


def vat_percent_from_comment(comment: Column | str) -> Column:
    return to_double(vat_text_from_comment(comment))


def _strip_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def general_number(value: Column) -> Column:
    """Six significant digits without trailing zeros."""
    size = F.abs(value)
    dec = value.cast("decimal(38,12)")
    digits = F.when(size >= 100000, F.bround(dec, 0).cast("string"))
    for places, floor in ((1, 10000), (2, 1000), (3, 100), (4, 10), (5, 1)):
        digits = digits.when(size >= floor, F.bround(dec, places).cast("string"))
    return _strip_zeros(digits.otherwise(F.bround(dec, 6).cast("string")))


def float_text(value: Column) -> Column:
    """A double the way it prints in payloads: shortest digits, at least one decimal."""
    wide = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"0+$", "")
    return F.when(
        (F.abs(value) < 1e7) & ((F.abs(value) >= 1e-3) | (value == 0)), value.cast("string")
    ).otherwise(F.regexp_replace(wide, r"\.$", ".0"))


def vat_display(vat_text: Column, vat_percent: Column, comment: Column) -> Column:
    """Register cell of the VAT rate: the printed text, else the percent, else the comment's note."""
    return F.coalesce(
        blank_to_null(vat_text), F.concat(general_number(vat_percent), F.lit("%")), vat_text_from_comment(comment)
    )


def line_sum_or_default(total: Column, quantity: Column, price: Column) -> Column:
    return F.coalesce(total, round_even(F.coalesce(quantity, F.lit(0.0)) * F.coalesce(price, F.lit(0.0))))


def gross_sum(net: Column, vat: Column) -> Column:
    """Net plus VAT on cents; net alone without VAT; null without net."""
    net_dec, vat_dec = decimal_or_null(net), decimal_or_null(vat)
    return F.bround(net_dec + F.coalesce(vat_dec, F.lit(0).cast("decimal(24,6)")), 2).cast("double")


def vat_included(total: Column, percent: Column) -> Column:
    """VAT contained in a gross sum; zero for rates of zero or less."""
    return F.when(percent > 0, round_even(total * percent / (100 + percent))).otherwise(F.lit(0.0))


def infer_vat_percent(net: Column, vat: Column) -> Column:
    """VAT percent implied by two sums, snapped to a standard rate when close to one."""
    usable = (F.coalesce(vat, F.lit(0.0)) != 0) & (F.coalesce(net, F.lit(0.0)) != 0)
    percent = F.when(usable, vat / net * 100)
    snapped = F.when(F.abs(percent - VAT_RATES[0]) <= VAT_SNAP, F.lit(float(VAT_RATES[0])))
    for rate in VAT_RATES[1:]:
        snapped = snapped.when(F.abs(percent - rate) <= VAT_SNAP, F.lit(float(rate)))
    return F.when(usable, snapped.otherwise(round_even(percent)))


def numbers_in(text: Column | str) -> Column:
    """All numbers of a text in reading order; grouped thousands count as one number."""
    spaced = F.replace(F.replace(as_col(text), F.lit("X"), F.lit(" ")), F.lit("x"), F.lit(" "))
    return F.filter(
        F.transform(F.regexp_extract_all(spaced, F.lit("(?U)" + NUMBER_RE), F.lit(1)), ocr_number),
        lambda n: n.isNotNull(),
    )


def tail_numbers(text: Column | str) -> Column:
    """Numbers of a row tail, one per blank separated token; grouped thousands are not joined."""
    spaced = F.translate(as_col(text), "\u00a0Xx", "   ")
    tokens = F.transform(F.split(spaced, r"(?U)\s+"), lambda t: strip_chars(t, " -—\t"))
    return F.transform(F.filter(tokens, lambda t: t.rlike(r"^\d+(?:[,.]\d+)?%?$")), ocr_number)


def is_number_line(line: Column) -> Column:
    return F.trim(line).rlike(r"(?U)^\d[\d\s]*(?:[,.]\d+)?%?$")


def is_integer_line(line: Column) -> Column:
    return F.trim(line).rlike(r"^\d{1,3}$")


def percent_in(line: Column | str) -> Column:
    """First percentage of a line; two digits at most, so it lies between 0 and 100."""
    line = as_col(line)
    return F.when(line.contains("%"), ocr_number(F.regexp_extract(line, PERCENT_RE, 1)))


def is_unit_code(value: Column, unit: Column) -> Column:
    """Classifier code of a measure: 166 or 796 for pieces, any three-digit integer otherwise."""
    whole = value == F.floor(value)
    pieces = F.lower(unit).isin("шт", "pcs")
    return whole & F.when(pieces, value.isin(*[float(c) for c in PIECE_CODES])).otherwise(value.between(100, 999))


def row_figures(numbers: Column, unit: Column) -> Column:
    """Roles of the numbers of one row: struct(quantity, price, sum, vat_percent, vat_sum), or null."""

    def without_code(all_numbers: Column) -> Column:
        coded = F.coalesce(is_unit_code(F.get(all_numbers, F.lit(0)), unit), F.lit(False))
        rest = F.slice(all_numbers, 2, F.greatest(F.size(all_numbers), F.lit(1)))
        return let(F.when(coded, rest).otherwise(all_numbers), _figures)

    return let(numbers, without_code)


def _figures(values: Column) -> Column:
    size = F.size(values)

    def nth(k: int) -> Column:
        return F.get(values, size - k)

    def figures(*ks: int) -> Column:
        quantity, price, total, percent, vat = (nth(k) if k else F.lit(None).cast("double") for k in ks)
        return F.struct(
            quantity.alias("quantity"), price.alias("price"), total.alias("sum"),
            percent.alias("vat_percent"), vat.alias("vat_sum"),
        )

    return (
        F.when((size >= 6) & nth(3).between(0, 100), figures(6, 5, 4, 3, 2))
        .when((size >= 5) & nth(2).between(0, 100), figures(5, 4, 3, 2, 1))
        .when(size >= 3, figures(3, 2, 1, 0, 0))
    )
