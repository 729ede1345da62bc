"""Stand-ins that were written are not put together again from the driver's tables."""

import pytest

from goodsledger.plans.catalogue import queries


@pytest.mark.parametrize("name", ["export_items", "export_receivings", "accounting_payload"])
def test_written_standins_are_read_again(spark, name):
    read = queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [path for path in read if "lineitem.parquet" in path or "orders.parquet" in path]
