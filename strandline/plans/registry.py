"""How queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry(queries: dict, oracle: dict[str, str]):
    """A decorator that registers a query under its name, with the SQL that
    gives its rows where SQL can."""

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return register

    return query


def rnd(c: Column | str, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)
