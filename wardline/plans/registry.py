"""Where queries and the SQL that says the same are registered."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: str, values: tuple[str | None, ...]) -> str:
    """SQL for the value at a number's remainder, in a form that both engines read."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


def facts(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A table made by SQL that both engines read, from the driver's tables of those names."""
    views = {name: f"wardline_{name}_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        table(spark, sf_dir, name).createOrReplaceTempView(view)
    out = spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {views.get(m[2], m[2])}", sql))
    for view in views.values():
        spark.catalog.dropTempView(view)
    return out


def values(rows: list[tuple]) -> str:
    """Rows as a VALUES list for the other engine."""
    say = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + ")"
