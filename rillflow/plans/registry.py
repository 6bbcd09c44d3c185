"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ("learning", "tables", "texts", "streams", "parts")


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under a name, with the SQL for the same rows where there is one."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"rillflow.plans.{module}")


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
