"""Readers and writers: Parquet globs, JSON lines, shapefiles, configuration."""

from __future__ import annotations

import json
import os
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.session import write_text
from terralith.sources.gazetteer import LANGUAGES, SAMPLE, natural_from_layer


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from JSON lines, in the schema of samples. A line that is no JSON fails the read: none goes missing unseen."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def next_sample_number(samples: DataFrame) -> int:
    """One more than the largest number at the end of ids like sample_000123; 0 without any."""
    top = samples.agg(F.max(F.regexp_extract("id", r"_(\d+)$", 1).cast("long"))).first()[0]
    return 0 if top is None else top + 1


def save_stats(spark: SparkSession, stats, path: str) -> None:
    """Statistics as a JSON file on whatever store the path names."""
    write_text(spark, path, json.dumps(stats, ensure_ascii=False, indent=2))


def read_config(path: str) -> dict:
    """A YAML (or JSON) configuration."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


# Shapefiles: little-endian records of points, lines and rings; attributes in a dBASE table beside them.


def _ring_area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _holds(ring, x: float, y: float) -> bool:
    inside = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            inside = not inside
    return inside


def _wkb_line(points) -> bytes:
    return struct.pack("<I", len(points)) + b"".join(struct.pack("<2d", *p) for p in points)


def shape_wkb(kind: int, body: bytes) -> bytes | None:
    """WKB of a shape record's content (points, multipoints, lines, polygons; heights and measures are dropped). Clockwise rings are shells, others holes of the shell that holds them."""
    base = kind % 10
    if kind == 0:
        return None
    if base == 1:
        return struct.pack("<BI2d", 1, 1, *struct.unpack_from("<2d", body, 0))
    if base == 8:
        n = struct.unpack_from("<i", body, 32)[0]
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI2d", 1, 1, *struct.unpack_from("<2d", body, 36 + 16 * i)) for i in range(n))
    parts, n = struct.unpack_from("<2i", body, 32)
    starts = [*struct.unpack_from(f"<{parts}i", body, 40), n]
    flat = struct.unpack_from(f"<{2 * n}d", body, 40 + 4 * parts)
    points = list(zip(flat[::2], flat[1::2]))
    lines = [points[a:b] for a, b in zip(starts, starts[1:]) if b > a]
    if base == 3:
        if len(lines) == 1:
            return struct.pack("<BI", 1, 2) + _wkb_line(lines[0])
        return struct.pack("<BII", 1, 5, len(lines)) + b"".join(struct.pack("<BI", 1, 2) + _wkb_line(x) for x in lines)
    shells = [[r] for r in lines if _ring_area(r) <= 0] or [[r] for r in lines[:1]]
    for hole in (r for r in lines if _ring_area(r) > 0 and all(r is not s[0] for s in shells)):
        home = next((s for s in shells if _holds(s[0], *hole[0])), None)
        (home if home is not None else shells[-1]).append(hole)
    polygon = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(_wkb_line, rings))
    return polygon(shells[0]) if len(shells) == 1 else struct.pack("<BII", 1, 6, len(shells)) + b"".join(map(polygon, shells))


def shapes(data: bytes) -> list[bytes | None]:
    """WKB of every record of a .shp file."""
    out, at = [], 100
    while at + 12 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        out.append(shape_wkb(struct.unpack_from("<i", data, at + 8)[0], data[at + 12 : at + 8 + length]))
        at += 8 + length
    return out


def attributes(data: bytes) -> list[dict]:
    """Rows of a .dbf file, as texts; deleted rows too, so that they stay beside their shapes."""
    n, header, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < header - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        row, p = {}, header + i * width + 1
        for name, size in fields:
            raw = data[p : p + size]
            try:
                row[name] = raw.decode("utf-8").strip("\0 ")
            except UnicodeDecodeError:
                row[name] = raw.decode("latin-1").strip("\0 ")
            p += size
        rows.append(row)
    return rows


# Layers without places: parts of names, and whole names.
SKIPPED_PARTS = ("graticules", "_label_points", "_scale_rank")
SKIPPED_LAYERS = ("ne_10m_land_ocean_seams", "ne_10m_wgs84_bounding_box", "ne_10m_geography_regions_points", "ne_10m_geography_regions_elevation_points")


def skipped_layer(name: str) -> bool:
    return name in SKIPPED_LAYERS or any(part in name for part in SKIPPED_PARTS)


_KEPT = ("ne_id", "featurecla", "name", *[f"name_{x}" for x in LANGUAGES], "sov_a3", "region")


def read_shapefiles(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """All layers under a folder (.shp with .dbf beside it) as natural features. Executors read a layer each; layers without places (`skipped_layer`) and those that `skip` names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[sd][hb][pf]").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    layers = files.select(stem.alias("layer"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"), "content").groupBy("layer").agg(F.first(F.when(F.col("kind") == "shp", F.col("content")), True).alias("shp"), F.first(F.when(F.col("kind") == "dbf", F.col("content")), True).alias("dbf"))

    def rows(batches):
        for batch in batches:
            for layer, shp, dbf in zip(batch["layer"], batch["shp"], batch["dbf"]):
                found = shapes(bytes(shp))
                named = [{k.lower(): v for k, v in r.items()} for r in attributes(bytes(dbf))] if dbf is not None else [{} for _ in found]
                yield pd.DataFrame([{"layer": layer, **{k: r.get(k) for k in _KEPT}, "geometry": g} for r, g in zip(named, found)], columns=["layer", *_KEPT, "geometry"])

    names = sorted(r["layer"] for r in layers.where("shp is not null").select("layer").distinct().collect())  # one name per file
    names = [n for n in names if n not in skip and not skipped_layer(n)]
    table = layers.where(F.col("layer").isin(*names) & F.col("shp").isNotNull()).mapInPandas(rows, f"layer string, {', '.join(f'{k} string' for k in _KEPT)}, geometry binary")
    out = None
    for name in names:
        one = natural_from_layer(table.where(F.col("layer") == name).drop("layer"), name)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no shapefiles under {folder}")
    return out
