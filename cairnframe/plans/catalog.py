"""What the queries of the library are registered in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, sql: str | None, *views: str):
    """Registers a function of views under a name, with DuckDB SQL over the same views; doubles are rounded to six places."""

    def keep(f):
        QUERIES[name] = lambda spark, d: rounded(f(*[view(spark, d, v) for v in views]))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views)
        return f

    return keep
