"""Registry of runnable queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from trialspark.adapters import VIEW_SQL, Tables, with_views

VIEWS = dict(VIEW_SQL)


@dataclass
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None = None
    #: Columns of floating-point arithmetic, whose last bits may differ from those of the check SQL.
    floats: tuple[str, ...] = field(default_factory=tuple)

    def frame(self, spark, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))

    def check_sql(self) -> str | None:
        return None if self.sql is None else with_views(self.sql, VIEWS)


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, floats: tuple[str, ...] | str = ()):
    """Register `fn(tables) -> DataFrame` under a name."""
    cols = tuple(floats.split()) if isinstance(floats, str) else tuple(floats)

    def add(fn):
        QUERIES[name] = Query(name, fn, sql, cols)
        return fn
    return add


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql
