"""Query registry: name -> (Spark plan, DuckDB oracle SQL or None, check class)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    check: str  # "S", "S*" or "R"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, check: str = "S"):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, check if sql is not None else "R")
        return fn

    return deco


_MEMO: dict = {}


def memo_result(fn: QueryFn) -> QueryFn:
    """Reuse a small expensive result (a sweep table) within one session, as a reliable checkpoint."""
    def wrapped(spark: SparkSession, sf: str) -> DataFrame:
        from .tables import fingerprint

        key = (fn.__name__, spark.sparkContext.applicationId, fingerprint(spark, sf))
        if key not in _MEMO:
            _MEMO[key] = fn(spark, sf).checkpoint()
        return _MEMO[key]

    wrapped.__name__ = fn.__name__
    wrapped.__doc__ = fn.__doc__
    return wrapped
