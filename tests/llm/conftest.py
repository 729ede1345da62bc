import os

import pytest

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside, as extra columns of the input.
CLASHING = ("_id", "_text", "_sha", "row", "key", "kept", "length", "found", "lanes", "recipe", "label", "block")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    prose = "The quick brown fox jumps over the lazy dog near the quiet river bank. " * 12
    rows = [
        (1, "hello world"), (2, "hello world"), (2, "hello world"), (None, "hello world"), (None, None), (3, None), (4, ""),
        (5, " \n\t "), (6, "x" * 300_000), (7, prose), (8, prose), (9, prose.replace("lazy", "tired", 1)), (7, "other text of seven"),
        (10, "word " * 60_000), (11, "é😀 naïve 日本語 'll don't  \x1c\u0085 <|endoftext|>"),
    ]
    fields = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *("c" for _ in CLASHING)) for i, t in rows], fields)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    fields = "doc_id long, quality int, toxic int, label string"
    return spark.createDataFrame([(7, 1, 0, "x"), (8, 1, 0, "x"), (6, 0, 1, "x"), (None, 1, 1, "x"), (9, None, None, "x")], fields)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "pages", "labels")}
