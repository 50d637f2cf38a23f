"""Registers each query next to the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from .standins import CTES, Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Decorates ``f(t: Tables) -> DataFrame`` as the query ``name``."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = f.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def define(name: str, sql: str) -> None:
    """A named SQL building block that oracles may select from."""
    CTES[name] = sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    for word in dict.fromkeys(re.findall(r"\b[a-z]\w*\b", sql)):
        if word in CTES and word not in seen:
            _needed(CTES[word], seen)
            if word not in seen:
                seen.append(word)
    return seen


def with_views(sql: str) -> str:
    """Prepends the stand-in views the statement uses."""
    sql = sql.strip()
    names = _needed(sql, [])
    if not names:
        return sql
    views = ",\n".join(f"{n} as materialized (\n{CTES[n].strip()}\n)" for n in names)
    if re.match(r"with\b", sql, re.I):
        return f"with {views},\n{sql[4:].lstrip()}"
    return f"with {views}\n{sql}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
