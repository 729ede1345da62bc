"""Text normalization as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings folded inside product names, applied in this order as plain substrings.
NAME_REPLACEMENTS = (
    ("гр.", "г"),
    ("гр", "г"),
    ("килограмм", "кг"),
    ("литр", "л"),
    ("штук", "шт"),
)

# Display texts that stand for "nothing recognized".
PLACEHOLDERS = (
    "поставщик не распознан",
    "точка доставки не распознана",
    "заведение не распознано",
    "склад не распознан",
    "подразделение не распознано",
    "не распознано",
    "не распознана",
    "требуется проверка",
)

# Word stems that mark a bracketed form hint.
FORM_HINT_STEMS = (
    "организац",
    "структурн",
    "адрес",
    "телефон",
    "факс",
    "банковск",
    "реквизит",
    "договор",
    "заказ",
    "должност",
    "расшифровка",
    "подпись",
    "пропись",
)

_HINT_STEMS_RE = "|".join(FORM_HINT_STEMS)
FORM_HINT_RE = r"(?iu)\s*\([^)]*(?:" + _HINT_STEMS_RE + r")[^)]*\)"
FORM_HINT_TAIL_RE = r"(?iu)\s*\([^)]*(?:" + _HINT_STEMS_RE + r")[^)]*\).*"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def words_pattern(words) -> str:
    """Pattern that finds any of the words. A place is left after one test of its character, unless a word may begin there."""
    heads = sorted({ord(word[0]) for word in words})
    starts = [h for h in heads if h - 1 not in heads]
    ends = [h for h in heads if h + 1 not in heads]
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))
    by_head = ("\\Q" + chr(h) + "\\E(?:" + "|".join("\\Q" + w[1:] + "\\E" for w in words if ord(w[0]) == h) + ")" for h in heads)
    return f"(?=[{ranges}])(?:" + "|".join(by_head) + ")"


def any_of(text: Column, words) -> Column:
    """True when one of the words occurs in the text; one pass, the text is evaluated once."""
    return matches(text, words_pattern(words))


def matches(text: Column, pattern: str) -> Column:
    """True when the pattern is found. Unlike ``rlike`` the pattern is not decoded again for each text of a lambda."""
    return F.regexp_instr(text, F.lit(pattern)) > 0


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def any_word(text: Column, words) -> Column:
    """True when one of the words occurs in the small letters of the text. A plain text is dismissed by its length."""
    low = F.lower(text)
    found = [low.contains(word) for word in words if word.isascii()]
    others = [word for word in words if not word.isascii()]
    if others:
        found.append(beyond_ascii(text) & any_of(low, others))
    return reduce(or_, found)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null without a match. The text is matched once, for patterns that match once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def squeeze(value: Column | str) -> Column:
    """Collapse every whitespace run (no-break spaces too) to one space and trim. A single space is no hit."""
    return F.trim(F.regexp_replace(as_col(value), r"(?U)(?: (?=\s)|(?! )\s)\s*", " "))


def blank_to_null(value: Column | str) -> Column:
    trimmed = F.regexp_replace(as_col(value), r"(?U)^\s+|\s+$", "")
    return F.nullif(trimmed, F.lit(""))


def fold_case(value: Column | str) -> Column:
    return F.translate(F.lower(F.coalesce(as_col(value).cast("string"), F.lit(""))), "ё", "е")


def _spaced(text: Column, kept: str) -> Column:
    """Runs of anything but a-z, 0-9 and the ``kept`` characters become one space.

    Single spaces, which would stay what they are, are no hit, and a place is left after one test of a plain class.
    """
    return F.regexp_replace(text, rf"(?:(?![a-z0-9 ])[^{kept}]| (?![a-z0-9{kept}]))[^a-z0-9{kept}]*", " ")


def normalize_product_name(value: Column | str) -> Column:
    """Lower, fold ё, keep letters, digits and ``% . , -``, squeeze, then fold unit spellings."""
    text = F.trim(_spaced(fold_case(value), r"а-я%.,\-"))
    for old, new in NAME_REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalize_catalog_text(value: Column | str) -> Column:
    """Letters and digits only, everything else becomes a single space."""
    return F.trim(_spaced(fold_case(value), "а-я"))


def name_tokens(normalized: Column) -> Column:
    """Distinct tokens of a normalized name; an empty name has none."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda token: token != ""))


def strip_chars(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def remove_form_hints(value: Column | str) -> Column:
    """Drop bracketed form hints such as "(организация, адрес, …)" and trim separators."""
    return strip_chars(squeeze(F.regexp_replace(as_col(value), FORM_HINT_RE, "")), " ;,.-—")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``; for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_placeholder(value: Column | str) -> Column:
    return let(
        F.lower(squeeze(value)),
        lambda text: (text == "")
        | text.isin(*PLACEHOLDERS)
        | text.startswith("распознано google drive ocr")
        | text.endswith("не распознана")
        | text.endswith("не распознано"),
    )


def display_value(value: Column | str) -> Column:
    """Value shown in a register cell: squeezed, without form hints; placeholders become blank."""
    cleaned = remove_form_hints(squeeze(F.coalesce(as_col(value), F.lit(""))))
    return let(cleaned, lambda c: F.when(is_placeholder(c), F.lit("")).otherwise(c))
