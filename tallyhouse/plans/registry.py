"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .shop import Shop, with_tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Shop], DataFrame] = field(repr=False)
    sql: str | None = field(repr=False, default=None)

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Shop(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, like: str | None = None):
    """Register ``build(shop)`` under its own name.  ``covers`` names the
    inventory entries; shop tables used in ``sql`` are added in front of it.
    ``like`` names the query whose result, and so its SQL, this one shares."""

    def register(build):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, build, QUERIES[like].sql if like else with_tables(sql) if sql else None)
        return build

    return register
