"""Numbers of a text too large for a long, against the query's SQL."""

import duckdb

from goodsledger.plans import catalogue
from tests.oracle import rows_of

TEXTS = [
    "99999999999999999999 88888888888888888888 7,25", "123456789012345678901234567890 1.5 3", "9007199254740993 0.5 18446744073709551616",
    "9223372036854775807 9223372036854775807 36893488147419103232,75", "12 3.5", "", None,
]


def test_numbers_beyond_a_long(spark, tmp_path):
    """Both sums overflowed a long before."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(catalogue.oracle_sql()["document_numbers"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = catalogue.queries()["document_numbers"](spark, str(tmp_path))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_numbers_beyond_38_digits_do_not_fail(spark, tmp_path):
    text = "9" * 60 + " 2 " + "8" * 400
    spark.createDataFrame([(1, text), (2, "9" * 60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in catalogue.queries()["document_numbers"](spark, str(tmp_path)).collect()}
    assert rows[1]["n_numbers"] == 3 and rows[1]["whole_total"] == float("inf") and rows[1]["fraction_total"] == 0
    assert rows[2]["whole_total"] == 1e60
