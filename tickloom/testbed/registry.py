"""Named queries over the given tables, each with the SQL it must agree with (if there is any)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


# Exact halves that two engines may see a bit apart would round apart; this moves them off.
NUDGE = 3e-10


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded as `oracle.fixed` does."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            column = F.round(column + F.lit(NUDGE), other.get(name, digits)) + F.lit(0.0)
        columns.append(column.alias(name))
    return df.select(*columns)
