"""Keeping relation tables current while features arrive: each micro-batch is joined to what is there, then appended.

This goes beyond the batch build: late and repeated features are dropped by a watermark on their arrival time, and a
batch that is delivered again overwrites its own output, so the tables stay right after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators import relations
from terralith.operators.spatial_join import spatial_pairs
from terralith.session import exists
from terralith.sources.gazetteer import with_box


def new_adjacencies(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pairs that touch and hold at least one fresh feature: fresh with fresh, and fresh with known. Known features that a fresh one replaces don't count."""
    known = known.join(fresh.select("id"), "id", "left_anti")
    inner = relations.adjacency(fresh)
    f, k = relations._named(with_box(fresh)), relations._named(with_box(known))
    across = spatial_pairs(f, k, "touches")
    swap = F.col("l_id") < F.col("r_id")
    columns = ("id", "name", "subtype", "country")
    outer = across.select(*[F.when(swap, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"anchor_{c}") for c in columns], *[F.when(swap, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(f"target_{c}") for c in columns], F.lit("adjacent").alias("relation_type"))
    return inner.unionByName(outer)


def start(spark: SparkSession, source: str, folder: str, checkpoint: str, schema, arrived: str | None = None, delay: str = "1 day", once: bool = True):
    """A streaming query that reads features from Parquet files in `source` and maintains `<folder>/features` and `<folder>/adjacency`."""
    stream = spark.readStream.schema(schema).parquet(source)
    if arrived:
        stream = stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["id"])

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["id"])
        if exists(spark, f"{folder}/features"):
            known = spark.read.parquet(f"{folder}/features").where(F.col("batch") < number).drop("batch")
        else:
            known = batch.limit(0)
        known = known.select(*batch.columns)
        new_adjacencies(known, batch).write.mode("overwrite").parquet(f"{folder}/adjacency/batch={number}")
        batch.write.mode("overwrite").parquet(f"{folder}/features/batch={number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
