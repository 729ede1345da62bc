"""Small helpers over arrays of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goodsledger.functions.text import let, matches  # noqa: F401  (let is re-exported)

MARK = "\u0001"


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def first_value(array: Column) -> Column:
    """First element that is not null."""
    return first(F.filter(array, lambda x: x.isNotNull()))


def after(array: Column, index: Column, count: int) -> Column:
    """Up to ``count`` elements following the zero-based ``index``."""
    return F.slice(array, index + 2, count)


def between(array: Column, start: Column, end: Column) -> Column:
    """Elements ``start`` (inclusive, zero-based) to ``end`` (exclusive); empty when end <= start."""
    return F.slice(array, start + 1, F.greatest(end - start, F.lit(0)))


def first_hit(options: Column) -> Column:
    """Value of the first option that has one or stops the search; options are struct(stop, value)."""
    return first(F.filter(options, lambda o: o["stop"] | o["value"].isNotNull()))["value"]


def option(stop: Column, value: Column) -> Column:
    return F.struct(F.coalesce(stop, F.lit(False)).alias("stop"), value.alias("value"))


def positions(array: Column, test: Callable[[Column], Column]) -> Column:
    """Zero-based positions of the elements that pass the test, ascending."""
    marks = F.transform(array, lambda x, i: F.when(test(x), i))
    return F.filter(marks, lambda i: i.isNotNull())


def first_position(array: Column, test: Callable[[Column], Column]) -> Column:
    return first(positions(array, test))


def hold(expression: Column, *arrays: Column) -> Column:
    """Guard an expression whose lambdas read ``arrays``.

    The guard is a second reference to each array, which keeps the optimizer from inlining the array's own
    expression into the lambda, where it would be computed once per element.
    """
    test = F.size(arrays[0]) >= -1
    for array in arrays[1:]:
        test = test & (F.size(array) >= -1)
    return F.when(test, expression)


def groups_of(text: Column, pattern: str, count: int) -> Column:
    """The groups of a pattern that spans the text, null without a match; one match, unless the text holds the mark."""
    marked = F.split(F.regexp_replace(text, pattern, MARK.join(f"${k}" for k in range(1, count + 1))), MARK)
    apart = F.when(matches(text, pattern), F.array(*[F.regexp_extract(text, pattern, k) for k in range(1, count + 1)]))
    return F.when(text.contains(MARK), apart).otherwise(let(marked, lambda parts: F.when(F.size(parts) == count, parts)))


def match_spans(text: Column, pattern: str, rank: int) -> Column:
    """Spans of all matches of a pattern: array of struct(start, rank, end), zero-based."""
    parts = F.split(F.regexp_replace(text, pattern, MARK + "$0"), MARK)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.expr("cast(array() as array<int>)"),
        lambda acc, part: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(part))),
    )
    return F.zip_with(
        starts,
        matches,
        lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end")),
    )


def exploded(df: DataFrame, array: Column, position: str, element: str, *keep: Column | str) -> DataFrame:
    """One row per element with its zero-based position.

    An inner explode makes the optimizer add a filter on the array's size and push it below the projections
    that compute the array, which computes it twice and unstaged. The outer form has no such filter; rows of
    empty arrays are dropped by their missing position.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, element)).where(F.col(position).isNotNull())
