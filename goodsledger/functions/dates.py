"""Dates and times."""

from __future__ import annotations

from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from goodsledger.functions.text import as_col, blank_to_null

# Month names and their numbers.
MONTHS = {
    "января": "01",
    "янв": "01",
    "февраля": "02",
    "фев": "02",
    "марта": "03",
    "мар": "03",
    "апреля": "04",
    "апр": "04",
    "мая": "05",
    "май": "05",
    "июня": "06",
    "июн": "06",
    "июля": "07",
    "июл": "07",
    "августа": "08",
    "авг": "08",
    "сентября": "09",
    "сент": "09",
    "сен": "09",
    "октября": "10",
    "окт": "10",
    "ноября": "11",
    "ноя": "11",
    "декабря": "12",
    "дек": "12",
}
_MONTH_RE = (
    r"(?iuU)\b(\d{1,2})[\s.-]+(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")[\s.-]+(\d{2,4})\b"
)
_FULL_RE = r"(\d{2})[./-](\d{2})[./-](\d{4})"
_ISO_RE = r"(\d{4}-\d{2}-\d{2})"
_SHORT_RE = r"(?U)\b(\d{1,2})[./-](\d{1,2})[./-](\d{2})\b"
_ANY_RE = r"(?U)\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b"

OFFSET_LIMIT = 14 * 60


def _groups(text: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]


def _year(raw: Column) -> Column:
    number = raw.try_cast("int")
    return F.when(number >= 100, number).otherwise(2000 + number).cast("string")


def _join(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _named_month(text: Column) -> Column:
    day, name, year = _groups(text, _MONTH_RE)
    pairs = [F.lit(x) for pair in MONTHS.items() for x in pair]
    number = F.try_element_at(F.create_map(*pairs), F.lower(name))
    return F.when(day != "", _join(_year(year), number, day))


def find_date(text: Column | str) -> Column:
    """First date of a text as yyyy-mm-dd: dd.mm.yyyy, then ISO, then d.m.yy, then a month name."""
    text = as_col(text)
    day, month, year = _groups(text, _FULL_RE)
    iso = F.regexp_extract(text, _ISO_RE, 1)
    day2, month2, year2 = _groups(text, _SHORT_RE)
    return F.coalesce(
        F.when(day != "", F.concat_ws("-", year, month, day)),
        F.when(iso != "", iso),
        F.when(day2 != "", _join(_year(year2), month2, day2)),
        _named_month(text),
    )


def find_date_in_transfer_form(text: Column | str) -> Column:
    """Variant for universal transfer documents: month names first, no ISO form."""
    text = as_col(text)
    day, month, year = _groups(text, _ANY_RE)
    return F.coalesce(_named_month(text), F.when(day != "", _join(_year(year), month, day)))


def reformat_date(value: Column | str, dotted: bool) -> Column:
    """Known date forms to dd.mm.yyyy (``dotted``) or yyyy-mm-dd; other texts pass through trimmed."""
    text = blank_to_null(value)
    head = F.substring(text, 1, 19)
    iso = F.regexp_extract(head, r"^(\d{4}-\d{1,2}-\d{1,2})$", 1)
    point = [F.regexp_extract(head, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", k) for k in (3, 2, 1)]
    moment = F.regexp_extract(head, r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})$", 1)
    parsed = F.coalesce(
        F.nullif(iso, F.lit("")).try_cast("date"),
        F.nullif(F.concat_ws("-", *point), F.lit("--")).try_cast("date"),
        F.nullif(moment, F.lit("")).try_cast("timestamp").cast("date"),
    )
    return F.coalesce(F.date_format(parsed, "dd.MM.yyyy" if dotted else "yyyy-MM-dd"), text)


@lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    return tuple(sorted(z for z in available_timezones() if z not in ("Factory", "localtime", "posixrules")))


def valid_zone(name: Column | str) -> Column:
    text = blank_to_null(name)
    return F.when(text.isin(*known_zones()), text)


def valid_offset(minutes: Column | str) -> Column:
    number = blank_to_null(as_col(minutes).cast("string")).try_cast("int")
    return F.when(number.between(-OFFSET_LIMIT, OFFSET_LIMIT), number)


def local_time_text(moment: Column, zone: Column, offset_minutes: Column) -> Column:
    """UTC time as the user's wall clock text: by zone, else by offset, else UTC."""
    zone, offset = valid_zone(zone), valid_offset(offset_minutes)
    by_zone = F.from_utc_timestamp(moment, F.coalesce(zone, F.lit("UTC")))
    by_offset = moment + F.make_interval(mins=F.coalesce(offset, F.lit(0)))
    return F.date_format(F.when(zone.isNotNull(), by_zone).otherwise(by_offset), "yyyy-MM-dd HH:mm:ss")
