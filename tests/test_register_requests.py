"""Register rows read the review requests that were written; lines are not put together for each side of a join."""

import pytest

from goodsledger.plans.catalogue import queries


@pytest.mark.parametrize("name", ["invoice_register", "merge_register"])
def test_requests_are_written_once(spark, name):
    read = queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [path for path in read if "lineitem.parquet" in path or "part.parquet" in path]
