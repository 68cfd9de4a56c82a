"""Registry of queries: an operator over logical views of the driver's tables, and its SQL check.

A view is one SELECT, valid in Spark and in DuckDB (or a pair of the two), over base tables or other
views written as {name}. The check shares only the views with the query, never the operator.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import Scratch

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VIEWS: dict[str, str | tuple[str, str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Attribute access to tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            else:
                text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
                self._made[name] = self.sql(text)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text))}
        return self._spark.sql(text, **used)


def duck_sql(body: str) -> str:
    """The check with every view it needs as a common table expression."""
    done: dict[str, str] = {}

    def need(text: str) -> str:
        for name in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
            if name not in TABLES and name not in done:
                view = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
                done[name] = need(view)
        return re.sub(r"\{(\w+)\}", r"\1", text)

    body = need(body).strip()
    ctes = [f"{name} AS ({text})" for name, text in done.items()]
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        body = body[own.end() :]
        return "WITH RECURSIVE " + ", ".join([*ctes, body])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def tidy(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows. If tables were written on the way, so are the rows, and those tables are deleted."""
    with Scratch(spark) as scratch:
        df = make()
        return scratch.hand_out(df, name) if scratch.paths or scratch.tables else df


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Views under a name, with the body of its SQL check."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: tidy(spark, name, lambda: f(Views(spark, sf_dir)))
        if sql:
            ORACLES[name] = duck_sql(sql)
        return f

    return add
