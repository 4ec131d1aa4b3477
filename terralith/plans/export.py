"""GeoJSON out of result frames."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.functions import call, register


def _geometry_columns(df: DataFrame) -> tuple[str | None, list[str]]:
    """The column that holds the features' geometry (GeoJSON text before WKB), and all columns that hold one."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and re.search("geom|geojson", f.name, re.IGNORECASE)]
    blobs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    every = texts + blobs
    return (every[0] if every else None), every


def feature_rows(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text in column `feature`, made by executors. Null properties are left out, other geometry columns too."""
    register(df.sparkSession)
    chosen, every = _geometry_columns(df)
    kinds = dict(df.dtypes)
    geometry = F.lit("null") if chosen is None else F.coalesce(call("st_asgeojson", F.col(chosen)) if kinds[chosen] == "binary" else F.when(F.col(chosen).startswith('{"type":'), F.col(chosen)), F.lit("null"))
    rest = [c for c in df.columns if c not in every]
    properties = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "true"}) if rest else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


#: Features that a collection in memory may have.
MOST_FEATURES = 50_000


def to_feature_collection(df: DataFrame, most: int = MOST_FEATURES) -> dict:
    """A FeatureCollection of a final result of at most `most` rows. A larger one is no answer to show: it raises, and is written by write_features."""
    rows = feature_rows(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features; write them with write_features")
    return {"type": "FeatureCollection", "features": [json.loads(r["feature"]) for r in rows]}


def write_features(df: DataFrame, folder: str) -> None:
    """Features of any number of rows, one per line, in part files."""
    feature_rows(df).write.mode("overwrite").text(folder)


def slug(question: str) -> str:
    return re.sub(r"[^\w]+", "_", question.strip().lower()).strip("_")[:80] or "result"


def save_geojson(df: DataFrame, question: str, folder: str) -> str:
    """Writes the collection to `<folder>/<slug of the question>.geojson`; the path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, slug(question) + ".geojson")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(to_feature_collection(df), file, ensure_ascii=False)
    return path


def collection_box(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row: the bounding box of all geometries, and the zoom that fits it: log2(360 / span) - 0.8, from 0 to 18."""
    register(df.sparkSession)
    box = df.select(call("st_box", geometry).alias("b")).agg(*[f(F.get("b", F.lit(i))).alias(n) for i, (n, f) in enumerate((("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max)))])
    span = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    zoom = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(18.0), F.log2(F.lit(360.0) / span) - 0.8))).otherwise(F.lit(18.0))
    return box.withColumn("zoom", zoom)
