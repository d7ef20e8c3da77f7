"""Registry of named queries and their SQL twins.

A query declares its output once, as ``name[:form]`` words: ``t`` timestamp text, ``d`` date text,
``r``/``rN`` number rounded to 6/N places, ``i`` long, ``s`` text, no form = as it is. The same
declaration shapes the Spark result and the SQL result. Numbers are rounded on their decimal form,
so that exact ties fall the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.plans.fixtures import Fixtures


def _spark(word: str) -> Column:
    name, _, form = word.partition(":")
    c = F.col(name)
    if form == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif form == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif form[:1] == "r":
        c = F.round(c.cast("double").cast("decimal(28,10)"), int(form[1:] or 6)).cast("double")
    elif form == "i":
        c = c.cast("long")
    elif form == "s":
        c = c.cast("string")
    return c.alias(name)


def _sql(word: str) -> str:
    name, _, form = word.partition(":")
    c = f'"{name}"'
    if form == "t":
        c = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    elif form == "d":
        c = f"strftime({c}, '%Y-%m-%d')"
    elif form[:1] == "r":
        c = f"CAST(round(CAST(CAST({c} AS DOUBLE) AS DECIMAL(28,10)), {form[1:] or 6}) AS DOUBLE)"
    elif form == "i":
        c = f"CAST({c} AS BIGINT)"
    elif form == "s":
        c = f"CAST({c} AS VARCHAR)"
    return f'{c} AS "{name}"'


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, cols: str, ctes: str | None = None, body: str | None = None):
        """Register ``fn(fixtures) -> DataFrame``. Without ``body`` there is no SQL twin."""
        words = cols.split()

        def register(fn: Callable[[Fixtures], DataFrame]):
            if name in self.queries:
                raise KeyError(name)

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(Fixtures(spark, sf_dir)).select(*[_spark(w) for w in words])

            run.__name__, run.__doc__ = name, fn.__doc__
            self.queries[name] = run
            if body is not None:
                head = f"WITH {ctes}\n" if ctes else ""
                self.sql[name] = f"{head}SELECT {', '.join(_sql(w) for w in words)} FROM ({body}) result_"
            return fn
        return register


REGISTRY = Registry()
