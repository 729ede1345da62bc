"""The crowded match reads its lines by columns, not from checkpoints of whole rows."""

from goodsledger.operators.crowded import match_crowded


def test_lines_are_read_by_columns(spark):
    fields = "receiving_id long, item_pos long, name string, quantity double, unit string, price double"
    order = spark.createDataFrame([(1, 1, "сыр твёрдый", 1.0, "кг", 5.0)], fields)
    invoice = spark.createDataFrame([(1, 1, "сыр твёрдый", 1.0, "кг", 5.0, False, None)], fields + ", crossed_out boolean, comment string")
    found = match_crowded(order, invoice)
    assert any("crowded_lines" in path for path in found.inputFiles())
    assert [r.status for r in found.collect()] == ["matched"]
