"""Row choice per key, and joins that write one table into another.

Every pick here thins out before the shuffle (a group limit or a partial aggregate on the map
side), so a key with very many rows sends only a few of them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = str | list[str]


def key_list(by: Keys) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _ranked(df: DataFrame, by: Keys, order: list[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key_list(by)).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def tail_rows(df: DataFrame, n: int, by: Keys = "symbol", order: Keys = "start") -> DataFrame:
    """The last n rows of each key."""
    return _ranked(df, by, [F.desc(c) for c in key_list(order)], n)


def dedup_keep_last(df: DataFrame, by: Keys, order: Keys) -> DataFrame:
    return tail_rows(df, 1, by, order)


def dedup_keep_first(df: DataFrame, by: Keys, order: Keys) -> DataFrame:
    return _ranked(df, by, [F.asc(c) for c in key_list(order)], 1)


def latest_per_key(df: DataFrame, by: Keys = "symbol", order: Keys = "start") -> DataFrame:
    """The row with the greatest `order` of each key: a group limit, so one row per key and task moves."""
    return tail_rows(df, 1, by, order)


def first_known(
    df: DataFrame, columns: list[str], by: Keys = "symbol", order: str = "start"
) -> DataFrame:
    """Per key the earliest known value of each column; null where a column is never known."""
    known_at = [F.when(F.col(c).isNotNull(), F.col(order)) for c in columns]
    return df.groupBy(*key_list(by)).agg(
        *[F.min_by(c, at).alias(c) for c, at in zip(columns, known_at)]
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on `keys` where null meets null; the keys come from the left."""
    rest = [c for c in right.columns if c not in keys]
    other = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *rest)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_on_{k}" for k in keys])  # semi and anti joins have none


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with every right column prefixed, so that both versions of a column are at hand."""
    prefixed = right.select(*[F.col(c).alias(f"_new_{c}") for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_new_{k}") for k in keys])
    return left.join(prefixed, on, how)


def coalescing_upsert(preferred: DataFrame, other: DataFrame, by: Keys) -> DataFrame:
    """Union of keys and columns; where both have a value, `preferred` wins.

    A null in `preferred` never overwrites a value of `other`.
    """
    keys = key_list(by)
    joined = _matched(preferred, other, keys, "full_outer")
    columns = preferred.columns + [c for c in other.columns if c not in preferred.columns]

    def pick(name: str) -> Column:
        sources = []
        if name in preferred.columns:
            sources.append(F.col(name))
        if name in other.columns:
            sources.append(F.col(f"_new_{name}"))
        return F.coalesce(*sources).alias(name)

    return joined.select(*[pick(c) for c in columns])


def masked_update(stored: DataFrame, update: DataFrame, by: Keys) -> DataFrame:
    """`stored` with the non-null values of `update` written in; new keys and columns are ignored."""
    keys = key_list(by)
    changed = [c for c in update.columns if c in stored.columns]
    joined = _matched(stored, update.select(*changed), keys, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
            if c in changed and c not in keys
            else F.col(c)
            for c in stored.columns
        ]
    )


def drop_closed(stored: DataFrame, closed: DataFrame, by: Keys) -> DataFrame:
    """`stored` without the keys found in `closed`."""
    keys = key_list(by)
    return stored.join(closed.select(*keys), keys, "left_anti")


def union_history(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_unique(df: DataFrame, by: Keys) -> DataFrame:
    """Fails the query when a key occurs twice; otherwise `df` with its rows unchanged.

    The check rides on the shuffle by key that the join after it needs anyway.
    """
    keys = key_list(by)
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest]
    )
    message = F.concat(F.lit("key occurs twice: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    only = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return counted.filter(only).select(*df.columns)
