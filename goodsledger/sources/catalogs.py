"""Accounting catalogs from JSON or XML files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from goodsledger.functions.arrays import exploded
from goodsledger.schemas import CATALOG, conform

# Keys a nameless entity is named after, in this order.
NAME_KEYS = ("displayName", "legalName", "fullName", "code")
_STRING_KEYS = (
    "id", "name", "code", "num", "displayName", "legalName", "fullName", "taxpayerIdNumber", "description",
    "shortName", "taxCategory", "tax_category", "vatPercent", "percent", "taxPercent",
)
_ENTITY = ", ".join(f"{k} string" for k in _STRING_KEYS)


def stated_percent(vat: Column, percent: Column, tax: Column) -> Column:
    """The first percent that is stated. A zero under one of the first two keys counts as not stated."""
    return F.coalesce(F.nullif(vat, F.lit(0.0)), F.nullif(percent, F.lit(0.0)), tax)


def _entities(raw: DataFrame, kind: str, named: Column | None = None) -> DataFrame:
    """Normalized catalog rows of one kind; ``raw`` holds the known keys and ``entity_pos``."""
    fallback = F.coalesce(*[F.nullif(k, F.lit("")) for k in NAME_KEYS])
    name = F.when(named, F.col("name")).otherwise(fallback) if named is not None else F.coalesce("name", fallback)
    number = stated_percent(*[F.nullif(F.col(k), F.lit("")).try_cast("double") for k in ("vatPercent", "percent", "taxPercent")])
    return conform(
        raw.withColumns(
            {
                "kind": F.lit(kind),
                "name": name,
                "taxCategory": F.coalesce(F.nullif("taxCategory", F.lit("")), F.nullif("tax_category", F.lit(""))),
                "vatPercent": number,
            }
        ),
        CATALOG,
    )



#: Positions of one file; files follow each other in order of their paths.
FILE_SPAN = 1 << 40


def read_catalog(spark: SparkSession, path: str, kind: str, fmt: str = "json", row_tag: str = "item") -> DataFrame:
    """Catalog of one kind from any number of files.

    ``json``: a file is one JSON array, or one object with ``items``, and is read whole. ``lines``: one JSON entity per
    line, also inside an array or ``items`` written that way; files of any size are split, lines that are no entity
    are left out. ``xml``: elements ``row_tag``; entities need an id, a name or a code.

    ``entity_pos`` is unique and follows the order of the paths, then that of the entities in a file.
    """
    if fmt == "xml":
        raw = spark.read.format("xml").option("rowTag", row_tag).schema(_ENTITY).load(path)
        usable = F.coalesce(*[F.nullif(k, F.lit("")) for k in ("id", "name", "code")])
        return _entities(_placed(raw).where(usable.isNotNull()), kind)
    if fmt == "lines":
        placed = _placed(spark.read.text(path))
        body = F.regexp_replace(F.trim(F.regexp_replace("value", "^\ufeff", "")), r"\s*,$", "")
        found = F.from_json(body, f"{_ENTITY}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
        rows = placed.where(body.startswith("{") & body.endswith("}")).select("entity_pos", found.alias("e"))
        return _entities(rows.where(F.col("e._broken").isNull()).select("entity_pos", "e.*"), kind)
    if fmt != "json":
        raise ValueError(f"unknown catalog format {fmt!r}")
    raw = spark.read.text(path, wholetext=True)
    texts = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"))
    return parse_catalog(_numbered(texts, raw.inputFiles()), kind)


def _placed(raw: DataFrame) -> DataFrame:
    """``entity_pos`` of rows read from split files: the file's place, the split's first byte, the row's place in it.

    A row takes a byte or more, so the rows of a split end before the next split begins; only one split is sorted at a time.
    """
    start = F.col("_metadata.file_block_start")
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), start.alias("_start"), F.monotonically_increasing_id().alias("_nth"))
    within = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_nth"))
    position = F.col("_place") * FILE_SPAN + F.col("_start") + within.cast("long") - 1
    return _numbered(rows, raw.inputFiles()).withColumn("entity_pos", position).drop("_file", "_start", "_nth", "_place")


def _numbered(rows: DataFrame, files: list[str]) -> DataFrame:
    """``_place``: the row's file among all files of the source, in order of their paths."""
    scheme = re.compile("^([a-z0-9]+:)/+")  # the two ways to name a file differ in the slashes behind the scheme
    named = [(scheme.sub(r"\1/", f), n) for n, f in enumerate(sorted(files))]
    places = rows.sparkSession.createDataFrame(named, "_file string, _place long")
    return rows.withColumn("_file", F.regexp_replace("_file", scheme.pattern, "$1/")).join(places, "_file")


def parse_catalog(texts: DataFrame, kind: str) -> DataFrame:
    """Catalog rows of JSON bodies (column ``text``): an array of entities, or an object with ``items``.

    Several bodies need a column ``_place``, a number of their own, so that positions stay unique.
    """
    place = F.col("_place") if "_place" in texts.columns else F.lit(0).cast("long")
    body = F.trim(F.col("text"))
    listed = F.from_json(F.when(body.startswith("["), body), f"array<struct<{_fields()}>>")
    wrapped = F.from_json(F.when(body.startswith("{"), body), f"items array<struct<{_fields()}>>")["items"]
    rows = exploded(texts.withColumn("_place", place), F.coalesce(listed, wrapped), "at", "e", "_place")
    rows = rows.where(F.col("e").isNotNull())
    return _entities(rows.select((F.col("_place") * FILE_SPAN + F.col("at")).alias("entity_pos"), "e.*"), kind)


def _fields() -> str:
    return ",".join(f"{k}:string" for k in _STRING_KEYS)
