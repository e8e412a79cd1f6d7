"""Named queries: one per inventory entry, with the SQL that checks it.

``query`` registers a builder ``Tables -> DataFrame`` under
``<id>_<name>``; the optional ``sql`` is DuckDB text over the same tables.
The registry feeds ``__spark_entry__.py``, the tests and the bench.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from geoloom.fixtures import Tables, with_views

_MODULES = ("rasters", "scenes", "polygons", "vectors", "labelling", "catalogs", "texts", "colors", "streams")


@dataclass(frozen=True)
class Query:
    id: str
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    @property
    def key(self) -> str:
        return f"{self.id.lower()}_{self.name}"

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


_QUERIES: dict[str, Query] = {}


def query(id: str, name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        q = Query(id, name, build, with_views(sql) if sql else None)
        if q.key in _QUERIES:
            raise ValueError(f"query {q.key} is registered twice")
        _QUERIES[q.key] = q
        return build

    return register


def all_queries() -> dict[str, Query]:
    for m in _MODULES:
        if importlib.util.find_spec(f"geoloom.plans.{m}") is None:
            continue
        importlib.import_module(f"geoloom.plans.{m}")
    return dict(_QUERIES)
