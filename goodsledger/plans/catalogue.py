"""All registered queries."""

from __future__ import annotations

import importlib

from goodsledger.plans.registry import QUERIES, Inputs

MODULES = ("reconciliation", "lifecycle_queries", "review_queries", "document_queries", "intake_queries")

for _name in MODULES:
    importlib.import_module(f"goodsledger.plans.{_name}")


def queries():
    def bind(q):
        return lambda spark, sf_dir: q.build(Inputs(spark, sf_dir))

    return {name: bind(q) for name, q in QUERIES.items()}


def oracle_sql():
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
