"""Texts inside lambdas are matched once: the same finds as the plain patterns, and no repeated steps in the plan."""

import re

from pyspark.sql import functions as F

from goodsledger.functions import numbers, text, units
from goodsledger.functions.arrays import groups_of
from goodsledger.operators.extract_items import _NUMBERED_RE, _ROW_WITH_UNIT_RE, _close

LINES = ["12 Сыр твёрдый", "7 abc кг 5", "3  x\u0001yz", "1 ab\u0001 кг\u0001 2", "12 \u0001abc", "", " a  b\tc  d ", "5", "масса", "MACCA", "Штук."]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_number_is_matched_once(spark):
    df = spark.createDataFrame([("1",)], "t string").select(F.transform(F.array("t"), numbers.ocr_number).alias("x"))
    assert _plan(df).count("regexp_extract") == 1


def test_an_expected_amount_is_worked_out_once_per_row(spark):
    near = F.transform(F.array("t"), lambda x: text.let(numbers.round_even(x), lambda v: _close(F.array(v), v)))
    assert _plan(spark.createDataFrame([(1.0,)], "t double").select(near.alias("x"))).count("bround") == 1


def test_a_unit_line_is_read_by_one_match_of_the_pattern(spark):
    df = spark.createDataFrame([(["кг"],)], "b array<string>").select(F.transform("b", units.unit_of_line).alias("x"))
    assert _plan(df).count("regexp_extract") == 1


def test_groups_are_those_of_the_pattern(spark):
    df = spark.createDataFrame([(line,) for line in LINES], "line string").select(
        "line", groups_of(F.col("line"), _NUMBERED_RE, 2).alias("n"), groups_of(F.col("line"), _ROW_WITH_UNIT_RE, 3).alias("u")
    )
    for row in df.collect():
        for found, pattern in ((row.n, _NUMBERED_RE), (row.u, _ROW_WITH_UNIT_RE)):
            plain = re.search(pattern.replace("(?U)", "").replace("(?iuU)", "(?i)"), row.line)
            assert found == (list(plain.groups()) if plain else None)


def test_spaces_and_words(spark):
    words = ("macca", "масса", "сыр")
    df = spark.createDataFrame([(line,) for line in LINES], "line string").select(
        "line", text.squeeze("line").alias("s"), text.any_word(F.col("line"), words).alias("w")
    )
    for row in df.collect():
        assert row.s == re.sub(r"\s+", " ", row.line).strip(" ") and row.w == any(w in row.line.lower() for w in words)
