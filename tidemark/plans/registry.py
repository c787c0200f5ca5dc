"""Registry of named queries: a Spark plan, its output columns and, where SQL can say it, the same in SQL.

The column text fixes names and presentation on both sides:
``s`` text, ``i`` integer, ``f``/``fN`` double rounded to 8/N decimals, ``t`` timestamp, ``d`` date, ``b`` boolean.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.domain import Domain
from tidemark.plans.oracle import with_views


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Domain], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(domain) -> DataFrame`` under ``name``."""
    cols = tuple(tuple(part.strip().split(":")) for part in columns.split(","))

    def add(build: Callable[[Domain], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, cols, build, sql)
        return build

    return add


def _digits(kind: str) -> int:
    return int(kind[1:]) if len(kind) > 1 else 8


def _off_tie(kind: str) -> float:
    """Small shift before rounding: engines break exact decimal ties differently."""
    return 0.0123 * 10.0 ** -_digits(kind)


def _spark_column(name: str, kind: str):
    col = F.col(name)
    if kind == "s":
        out = col.cast("string")
    elif kind == "i":
        out = col.cast("bigint")
    elif kind.startswith("f"):
        out = F.round(col.cast("double") + F.lit(_off_tie(kind)), _digits(kind)) + F.lit(0.0)
    elif kind == "t":
        out = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    elif kind == "d":
        out = F.date_format(col, "yyyy-MM-dd")
    elif kind == "b":
        out = col.cast("string")
    else:
        raise ValueError(kind)
    return out.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "s" or kind == "b":
        text = f"CAST({name} AS VARCHAR)"
    elif kind == "i":
        text = f"CAST({name} AS BIGINT)"
    elif kind.startswith("f"):
        text = f"round(CAST({name} AS DOUBLE) + CAST({_off_tie(kind):e} AS DOUBLE), {_digits(kind)}) + CAST(0 AS DOUBLE)"
    elif kind == "t":
        text = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    else:
        text = f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
    return f"{text} AS {name}"


def run(q: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = q.build(Domain(spark, sf_dir))
    return out.select(*[_spark_column(n, k) for n, k in q.columns])


def sql_text(q: Query) -> str | None:
    if q.sql is None:
        return None
    body = re.sub(r"\n\s*", "\n", q.sql.strip())
    shown = ", ".join(_sql_column(n, k) for n, k in q.columns)
    return with_views(f"SELECT {shown} FROM (\n{body}\n) AS result_rows")
