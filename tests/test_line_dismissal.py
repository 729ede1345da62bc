"""Short tests that dismiss lines early: the same finds as the plain patterns, and fewer costly steps."""

import re

from pyspark.sql import functions as F

from goodsledger.functions import numbers, text
from goodsledger.functions.parties import HEADING_MARKERS
from goodsledger.functions.products import NAME_NOISE, TRANSFER_NOISE
from goodsledger.operators.extract_items import TABLE_STOPS

LINES = ["итого 5", "x всего по накладнои", "всего по накладной", "", "abc 12,5", "2a", "сумма с учётом ндс", "от кого", "товара", "брутто.", "(груз)"]


def test_words_are_found_like_by_a_plain_search(spark):
    lists = (TABLE_STOPS, HEADING_MARKERS, NAME_NOISE, TRANSFER_NOISE, ("%", "ндс", "]a", "x-"), ("«", '"', "сыр"))
    found = spark.createDataFrame([(line,) for line in LINES], "line string").select(
        "line", *[text.any_of(F.col("line"), words).alias(f"w{n}") for n, words in enumerate(lists)]
    )
    for row in found.collect():
        assert list(row)[1:] == [any(w in row["line"] for w in words) for words in lists]


def test_a_place_is_left_after_one_test():
    """Each word was tried at each place of a line before."""
    pattern = text.words_pattern(TABLE_STOPS)
    ranges = re.match(r"\(\?=\[(.*?)\]\)", pattern).group(1)
    bounds = [int(h, 16) for h in re.findall(r"\\x\{([0-9a-f]+)\}", ranges)]
    inside = {chr(c) for a, b in zip(bounds[::2], bounds[1::2], strict=True) for c in range(a, b + 1)}
    assert inside == {word[0] for word in TABLE_STOPS}


def test_small_int_is_null_without_a_cast(spark):
    rows = [("12",), ("",), ("1x",), ("007",), ("1234567890",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(numbers.small_int(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [12, None, None, 7, None, None]
