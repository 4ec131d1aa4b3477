"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hashed_rank(df: DataFrame, keys: list[str], seed: str, id_column: str, out: str = "rank") -> DataFrame:
    """Adds `out`, from 1: the position of each row in its group in the order of md5(seed, id), and `<out>_of`, the group's size.

    The hash's first digits cut each group into 4096 parts; ranks inside a part are added to the sizes of the parts before it,
    so no task sorts a whole group. Null keys are one group, ids should be unique; equal hashes are ordered by id.
    """
    df = df.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(id_column).cast("string")))).withColumn("_part", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    names = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, k in enumerate(keys)]
    df = df.select("*", *names)
    groups = [f"_k{i}" for i in range(len(keys))]
    parts = df.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).withColumn("_of", F.sum("_n").over(Window.partitionBy(*groups))).drop("_n")
    ranked = df.join(parts, [*groups, "_part"])
    inside = Window.partitionBy(*groups, "_part").orderBy("_hash", id_column)
    return ranked.withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("long")).withColumnRenamed("_of", f"{out}_of").drop("_hash", "_part", "_before", *groups)


def sample_rows(df: DataFrame, n: int, seed: str, id_column: str = "id") -> DataFrame:
    """`n` rows, always the same for a seed: the first in the order of md5(seed, id). A top-k, without a sort of the table."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(id_column).cast("string"))), id_column).limit(n)
