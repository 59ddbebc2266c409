"""Queries over the driver's tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ["beat", "join", "evaluation", "activity", "session", "history", "record", "signal", "model",
            "legacy", "note", "source", "sink", "stream"]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_found: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under `name`."""
    def add(fn):
        if name in _found:
            raise ValueError(f"query {name} is registered twice")
        _found[name] = Query(fn, sql)
        return fn
    return add


def all_queries() -> dict[str, Query]:
    for family in FAMILIES:
        try:
            import_module(f"pulsegrid.catalog.{family}")
        except ModuleNotFoundError as e:
            if e.name != f"pulsegrid.catalog.{family}":
                raise
    return dict(_found)
