"""Joins that withstand hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key that one task may get; a hotter key is spread over several.
HOT_ROWS = 50_000
#: Hot keys are at most (rows / HOT_ROWS); so many may be broadcast.
MOST_HOT = 200_000


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes values of this type: maps, and what holds them, have no hash."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def salted_join(many: DataFrame, few: DataFrame, key: str, hot_rows: int | None = None, counts: DataFrame | None = None, tasks: int | None = None, third: DataFrame | None = None) -> DataFrame:
    """Inner join on `key` in which a hot key's rows of `many` go to several tasks and its rows of `few` to each of them.

    `many` is counted by key first (combined before the shuffle), so it should be cheap to read twice; or `counts` says it: (key, _n), where
    _n may also count rows of the result. `tasks` fixes how many tasks join: Spark would merge them by the bytes that they read. `third` is a further
    table to join by the same key, in the same tasks. Null keys join nothing.
    """
    hot_rows = hot_rows or HOT_ROWS
    if counts is None:
        counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    spread_out = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    hot = counts.where(F.col("_n") > hot_rows).select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    found = hot.limit(MOST_HOT + 1).count()
    if found == 0:
        return reduce(lambda a, b: a.join(b, key), [spread_out(df, key) for df in (many, few, third) if df is not None])
    hot = F.broadcast(hot) if found <= MOST_HOT else hot
    spread = F.xxhash64(*[f"`{f.name}`" for f in many.schema if _hashable(f.dataType)])
    left = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts"))).otherwise(0).cast("int")).drop("_salts")
    copied = [df.join(hot, key, "left").withColumn("_salt", F.explode(F.expr("sequence(0, coalesce(_salts, 1) - 1)"))).drop("_salts") for df in (few, third) if df is not None]
    return reduce(lambda a, b: a.join(b, [key, "_salt"]), [spread_out(df, key, "_salt") for df in (left, *copied)]).drop("_salt")
