"""Registry of named queries: a Spark function and, where one exists, its plain SQL twin."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrakit.bindings import BINDINGS, Tables, with_bindings

__all__ = ["BINDINGS", "Query", "Tables", "all_queries", "query"]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Tables(spark, sf_dir))


_QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables)`` under ``name``.

    ``covers`` lists inventory ids, ``uses`` the bindings the SQL twin needs.
    """

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        text = with_bindings(uses.split(), sql) if sql else None
        _QUERIES[name] = Query(name, tuple(covers.split()), fn, text)
        return fn

    return wrap


def all_queries() -> dict[str, Query]:
    package = importlib.import_module("terrakit.queries")
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"terrakit.queries.{module.name}")
    return dict(_QUERIES)
