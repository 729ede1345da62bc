"""Patched documents need no match of lines, and receivings are put together once."""

from goodsledger.plans.catalogue import queries


def test_documents_are_patched_from_the_headers_alone(spark):
    read = queries()["patched_documents"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [path for path in read if "lineitem.parquet" in path or "orders.parquet" in path or "part.parquet" in path]
