"""Named queries with the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from goodsledger.plans.standins import ctes, table
from goodsledger.session import stored


class Inputs:
    """Lazy access to the tables and stand-ins of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._kept = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name, self._kept)

    def keep(self, name: str) -> DataFrame:
        """The stand-in written once; whatever is derived from it afterwards reads what was written."""
        if name not in self._kept:
            self._kept[name] = stored(getattr(self, name), name)
        return self._kept[name]


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), recursive: bool = False):
    """Register a query. ``sql`` is a select over driver tables and the stand-ins named in ``needs``."""

    def wrap(build: Callable[[Inputs], DataFrame]):
        text = None
        if sql is not None:
            head = ctes(*needs)
            body = sql.strip()
            if head and body.lower().startswith("with "):
                text = f"with {'recursive ' if recursive else ''}{head},\n{body[5:]}"
            elif head:
                text = f"with {'recursive ' if recursive else ''}{head}\n{body}"
            else:
                text = body
        QUERIES[name] = Query(build, text)
        return build

    return wrap
