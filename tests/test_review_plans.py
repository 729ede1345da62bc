"""Chains of joins on one receiving are cut: few sorts share a task's memory, and the given tables are read once."""

from goodsledger.plans.catalogue import queries

SF = "/root/testdata/sf0.001"


def test_exports_and_sync_join_what_was_written(spark):
    for name in ("review_exports", "sync_and_send"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= 8, plan.count("Join ")
        assert "l_orderkey" not in plan
