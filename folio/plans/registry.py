"""All registered queries."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from ..session import ship_package

AREAS = ["markup_queries", "reference_queries", "content_queries", "ledger_queries", "project_queries", "live_queries"]


class Registry:
    """Collects (name, query, SQL) of one area."""

    def __init__(self) -> None:
        self.entries: dict[str, tuple] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            if name in self.entries:
                raise ValueError(f"query {name} is registered twice")
            self.entries[name] = (fn, sql)
            return fn

        return keep


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for area in AREAS:
        found.update(import_module(f"folio.plans.{area}").REGISTRY.entries)
    return found


def _ready(fn):
    """The query, with this package known to the Python workers of whatever session it is given."""

    @wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _ready(fn) for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
