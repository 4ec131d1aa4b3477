"""Taking the first rows of every group in the order of a random key, without sorting a group in one task.

The key's range is cut into `BUCKETS` equal parts. Sizes per group and part (combined before the shuffle) give, by a running
sum over the few parts, for each group the parts that are taken whole, and the one part that the quota ends in. Only rows of
that part are ranked, by (group, part), so the largest window holds about 1/BUCKETS of a group however hot it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Quota rows (groups) that may be broadcast; beyond that the joins shuffle.
BROADCAST_GROUPS = 20_000


def unit_hash(*columns):
    """A uniform double in (0, 1) that depends on the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") + 0.5) / float(1 << 52)


def take_prefix(rows: DataFrame, quota: DataFrame, keys: list[str], order: str, id_column: str, size: str | None = None) -> DataFrame:
    """The rows of each group with the smallest `order` (a double in (0, 1)) that the group's `quota` has room for.

    rows: `keys`, `order`, `id_column` (ties of `order` are broken by it) and, where `size` names one, a column of sizes.
    quota: `keys` (unique) and `quota`, a number of rows, or of units of size. A row is taken if the sizes before it sum to
    less than the quota, so that a quota of sizes is reached rather than missed by the last row. Groups without a quota row
    or with a quota of 0 or null give nothing. Extra columns of `rows` are kept.
    """
    weight = F.col(size).cast("double") if size else F.lit(1.0)
    quota = quota.where(F.col("quota") > 0).select(*keys, F.col("quota").cast("double").alias("_quota"))
    rows = rows.withColumn("_part", F.least(F.floor(F.col(order) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).withColumn("_size", F.coalesce(weight, F.lit(0.0)))
    parts = rows.groupBy(*keys, "_part").agg(F.sum("_size").alias("_sum"))
    # one row for each group and part: at most BUCKETS rows in a window
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0.0))).join(quota, keys)
    parts = parts.where(F.col("_before") < F.col("_quota")).withColumn("_whole", F.col("_before") + F.col("_sum") <= F.col("_quota"))
    parts = parts.select(*keys, "_part", "_before", "_quota", "_whole")
    held = rows.join(parts, [*keys, "_part"])
    whole = held.where("_whole")
    inside = Window.partitionBy(*keys, "_part").orderBy(order, id_column).rowsBetween(Window.unboundedPreceding, -1)
    edge = held.where("not _whole").withColumn("_at", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0.0))).where("_at < _quota").drop("_at")
    return whole.unionByName(edge).drop("_part", "_size", "_before", "_quota", "_whole")
