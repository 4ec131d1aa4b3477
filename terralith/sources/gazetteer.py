"""The place tables: schemas, vocabularies, normalisation, inventory, and registration as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import call, register
from terralith.session import exists, table

# Subtypes of the two sources that queries and relations use.
DIVISION_SUBTYPES = ("country", "region", "county")
NATURAL_SUBTYPES = ("ocean", "sea", "bay", "gulf", "strait", "river", "lake", "basin", "range/mtn", "peninsula", "island group", "plateau", "plain", "lowland", "valley", "depression", "gorge")
# Language columns of natural feature names.
LANGUAGES = ("ar", "bn", "de", "en", "es", "fr", "el", "hi", "hu", "id", "it", "ja", "ko", "nl", "pl", "pt", "ru", "sv", "tr", "vi", "zh", "fa", "he", "uk", "ur", "zht")

DIVISIONS = (
    "id string, names struct<primary: string, common: map<string, string>>, country string, subtype string, class string, region string, admin_level int, division_id string, is_land boolean, is_territorial boolean, geometry binary"
)
NATURAL = (
    f"id string, source_layer string, names struct<primary: string, {', '.join(f'{x}: string' for x in LANGUAGES)}>, subtype string, class string, country string, region string, admin_level int, is_land boolean, is_territorial boolean, geometry binary"
)
CANDIDATE = ("candidate_id string, source string, id string, name string, subtype string, country string, region string, admin_level int, similarity double")
SAMPLE = (
    f"id string, question string, candidates array<struct<{CANDIDATE.replace(" ", ":").replace(",:", ",")}>>, target struct<selected_candidates: array<string>, sql: string>, metadata struct<task_family: string, sql_difficulty: string, grounding_difficulty: string, template_id: string, num_candidates: int, anchor_source: string, sql_verified: boolean, surface_variants: array<string>>"
)

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_box(features: DataFrame) -> DataFrame:
    """Adds the bounding box as four double columns, reading each geometry once; they are null where it is null or empty."""
    register(features.sparkSession)
    if set(BOX) <= set(features.columns):
        return features
    boxed = features.withColumn("_box", call("st_box", "geometry"))
    return boxed.select(*features.columns, *[F.get("_box", F.lit(i)).alias(c) for i, c in enumerate(BOX)])


def read(spark: SparkSession, directory: str, source: str, prefer_normalized: bool = True) -> DataFrame:
    """A source table of a data directory; its normalised copy (`<source>_normalized.parquet`) where there is one and it is preferred."""
    copy = f"{directory.rstrip('/')}/{source}_normalized.parquet"
    if prefer_normalized and exists(spark, copy):
        return spark.read.parquet(copy)
    return table(spark, directory, source)


def normalize_divisions(divisions: DataFrame) -> DataFrame:
    """Land areas of the three subtypes that have a geometry, with lower-case subtypes and bounding boxes, sorted by id for pruning."""
    kept = divisions.withColumn("subtype", F.lower(F.trim("subtype"))).where(F.col("geometry").isNotNull() & F.col("subtype").isin(*DIVISION_SUBTYPES) & F.col("is_land"))
    return with_box(kept).sortWithinPartitions("id")


def normalize_natural(features: DataFrame) -> DataFrame:
    """Natural features that have a geometry, with lower-case subtypes and bounding boxes."""
    kept = features.withColumn("subtype", F.lower(F.trim("subtype"))).where(F.col("geometry").isNotNull())
    return with_box(kept).sortWithinPartitions("id")


def normalize(spark: SparkSession, directory: str, out: str) -> None:
    """Writes the normalised copies of both tables."""
    normalize_divisions(table(spark, directory, "divisions_area")).write.mode("overwrite").parquet(f"{out}/divisions_area_normalized.parquet")
    normalize_natural(table(spark, directory, "natural_earth")).write.mode("overwrite").parquet(f"{out}/natural_earth_normalized.parquet")


def natural_from_layer(layer: DataFrame, key: str) -> DataFrame:
    """A layer of natural features (attribute columns of a shapefile, and geometry) in the table's schema.

    The id comes from ne_id, else from the layer's name and the row's content; the name from one column of the layer: the first of name, name_en and the
    other language columns that it has; blank and placeholder names are null; is_land follows from the layer's name, null where that says nothing.
    """
    columns = {c.lower(): c for c in layer.columns}

    def text(name: str):
        value = F.trim(F.col(f"`{columns[name]}`").cast("string")) if name in columns else F.lit(None).cast("string")
        return F.when(~F.lower(value).isin("", "nan", "none"), value)

    languages = F.struct(
        text(next((n for n in ("name", "name_en", *[f"name_{x}" for x in LANGUAGES]) if n in columns), "name")).alias("primary"), *[text(f"name_{x}").alias(x) for x in LANGUAGES]
    )
    made = F.concat(F.lit(f"ne_10m_{key}_"), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in layer.columns])))
    # What a layer's name says about land; other names say nothing
    land = False if re.search("ocean|marine|bathymetry|coastline|seams|reefs", key) else True if re.search("land|lakes|regions", key) else None
    return layer.select(
        F.coalesce(F.concat(F.lit("ne_"), text("ne_id")), made).alias("id"), F.lit(key).alias("source_layer"), languages.alias("names"), F.lower(F.coalesce(text("featurecla"), F.lit(key))).alias("subtype"), F.lit(None).cast("string").alias("class"),
        text("sov_a3").alias("country"), text("region").alias("region"), F.lit(None).cast("int").alias("admin_level"), F.lit(land).cast("boolean").alias("is_land"), F.lit(None).cast("boolean").alias("is_territorial"), F.col(f"`{columns['geometry']}`").alias("geometry"),
    )


def inventory(features: DataFrame, source: str) -> DataFrame:
    """One row per named feature with a geometry: identity, area in square degrees and bounding box."""
    register(features.sparkSession)
    named = features.where(F.col("geometry").isNotNull() & (F.trim("names.primary") != ""))
    columns = ["id", F.col("names.primary").alias("name"), "subtype", "country", "region", "admin_level", "class", "is_land", "is_territorial"]
    if "division_id" in features.columns:
        columns.append("division_id")
    return with_box(named).select(F.lit(source).alias("source"), *columns, call("st_area", "geometry").alias("area_sq_deg"), *BOX)


def register_views(spark: SparkSession, directory: str, prefer_normalized: bool = True) -> None:
    """Both tables as temporary views under their own names, for SQL."""
    register(spark)
    for source in ("divisions_area", "natural_earth"):
        with_box(read(spark, directory, source, prefer_normalized)).createOrReplaceTempView(source)
