"""Named queries, one or more per operator, with the SQL their results must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loam.bindings import Tables, oracle

SECTIONS = ["projections", "scalars", "joins", "aggregates", "windows", "ordering", "sources",
            "streams", "statements"]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; `sql` may name bound frames after FROM and JOIN."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query named twice: {name}")
        _QUERIES[name] = Query(name, build, oracle(sql) if sql else None)
        return build
    return register


def all_queries() -> dict[str, Query]:
    for section in SECTIONS:
        importlib.import_module(f"loam.catalogue.{section}")
    return dict(_QUERIES)
