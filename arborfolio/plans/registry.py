"""Registry of the portfolio queries and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named step of the SQL oracles."""
    _VIEWS[name] = sql


def oracle(final: str) -> str:
    """``final`` with all the named steps that it needs, as one statement."""
    order: list[str] = []
    met: set[str] = set()

    def need(sql: str) -> None:
        for name in re.findall(r"[a-z_][a-z0-9_]*", sql):
            if name in _VIEWS and name not in met:
                met.add(name)
                need(_VIEWS[name])
                order.append(name)

    need(final)
    steps = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order)
    recursive = "RECURSIVE " if any("UNION ALL" in _VIEWS[n] and re.search(rf"\b{n}\b", _VIEWS[n]) for n in order) or final.startswith("WITH RECURSIVE") else ""
    own = re.match(r"WITH (?:RECURSIVE )?(.*)", final, re.S)
    if own:
        return f"WITH {recursive}" + ",\n".join([steps, own[1]] if order else [own[1]])
    return (f"WITH {recursive}{steps}\n" if order else "") + final


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle over the tables and the named steps."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def load() -> None:
    from arborfolio.plans import adaptive_queries, allocation_queries, catalog_queries, document_queries, frontier_queries, ledger_queries, panel_queries, risk_queries, tree_queries  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return {name: oracle(sql) for name, sql in _SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return _QUERIES["performance_metrics"](spark, sf_dir)
