"""A gazetteer of axis-aligned boxes derived from the star-schema tables: every spatial answer is plain arithmetic too.

Seas and oceans lie in the western half, so that there are landlocked divisions; some oceans are wide enough to hold whole regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import call, register
from terralith.session import table

NATURAL = ("ocean", "sea", "river", "lake", "basin", "range/mtn", "plateau", "depression")

#: Oceans that hold whole regions.
WIDE = "p_partkey % 8 = 0 AND p_size = 50"

#: The same features for an engine without spatial functions: CTEs d (divisions) and n (natural features) with box corners.
SQL = f"""
nat AS (SELECT *, 128 * n_regionkey + 16 * (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS x0 FROM nation),
d AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'country' AS subtype, 'R' || r_regionkey AS country, CAST(NULL AS VARCHAR) AS region, 0 AS admin_level, true AS is_land, r_regionkey % 2 = 0 AS is_territorial,
         CAST(128 * r_regionkey AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(128 * r_regionkey + 128 AS DOUBLE) AS x1, CAST(128 AS DOUBLE) AS y1 FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'region', 'R' || n_regionkey, 'R' || n_regionkey || '-' || n_nationkey, 1, n_nationkey % 4 <> 0, n_nationkey % 3 = 0, x0, 0, x0 + 16, 128 FROM nat
  UNION ALL SELECT 'c' || c_custkey, c_name, 'county', 'R' || n_regionkey, 'R' || n_regionkey || '-' || n_nationkey, 2, c_custkey % 2 = 0, c_custkey % 3 = 0,
         x0 + c_custkey % 16, (c_custkey // 16) % 128, x0 + c_custkey % 16 + 1, (c_custkey // 16) % 128 + 1 FROM customer JOIN nat ON c_nationkey = n_nationkey),
n AS (SELECT 'ne_' || p_partkey AS id, p_name AS name, ['{"', '".join(NATURAL)}'][CAST(p_partkey % 8 + 1 AS INTEGER)] AS subtype, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS INTEGER) AS admin_level, p_partkey % 8 > 1 AS is_land, CAST(NULL AS BOOLEAN) AS is_territorial,
         CAST(CASE WHEN {WIDE} THEN (37 * p_partkey) % 320 // 16 * 16 WHEN p_partkey % 8 < 2 THEN (37 * p_partkey) % 320 ELSE (37 * p_partkey) % 640 END AS DOUBLE) AS x0, CAST(CASE WHEN {WIDE} THEN 0 ELSE (53 * p_partkey) % 128 END AS DOUBLE) AS y0,
         CAST(CASE WHEN {WIDE} THEN (37 * p_partkey) % 320 // 16 * 16 + 32 ELSE (37 * p_partkey) % CASE WHEN p_partkey % 8 < 2 THEN 320 ELSE 640 END + 1 + p_size % 16 END AS DOUBLE) AS x1,
         CAST(CASE WHEN {WIDE} THEN 128 ELSE (53 * p_partkey) % 128 + 1 + p_size % 8 END AS DOUBLE) AS y1 FROM part)
""".strip().replace('["', "['").replace('"', "'")


def _geometry(df: DataFrame) -> DataFrame:
    register(df.sparkSession)
    return df.withColumn("geometry", call("st_makeenvelope", "xmin", "ymin", "xmax", "ymax"))


def divisions(spark, directory: str) -> DataFrame:
    """Countries from region, regions from nation, counties from customer, in the schema of divisions_area, with boxes."""
    slot = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    nation = table(spark, directory, "nation").withColumn("x0", (128 * F.col("n_regionkey") + 16 * slot).cast("double"))
    code = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    area = F.concat(code, F.lit("-"), F.col("n_nationkey").cast("string"))

    def rows(df, key, name, subtype, country, region, level, land, territorial, x0, y0, x1, y1):
        names = F.struct(F.col(name).alias("primary"), F.create_map(F.lit("en"), F.col(name)).alias("common"))
        box = [F.expr(v).cast("double").alias(c) if isinstance(v, str) else v.cast("double").alias(c) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), (x0, y0, x1, y1))]
        return df.select(key.alias("id"), names.alias("names"), country.alias("country"), F.lit(subtype).alias("subtype"), F.lit("land").alias("class"), region.alias("region"), F.lit(level).alias("admin_level"), key.alias("division_id"), land.alias("is_land"), territorial.alias("is_territorial"), *box)

    region = table(spark, directory, "region")
    top = rows(region, F.expr("concat('r', r_regionkey)"), "r_name", "country", F.expr("concat('R', r_regionkey)"), F.lit(None).cast("string"), 0, F.lit(True), F.expr("r_regionkey % 2 = 0"), "128 * r_regionkey", "0", "128 * r_regionkey + 128", "128")
    middle = rows(nation, F.expr("concat('n', n_nationkey)"), "n_name", "region", code, area, 1, F.expr("n_nationkey % 4 <> 0"), F.expr("n_nationkey % 3 = 0"), "x0", "0", "x0 + 16", "128")
    customer = table(spark, directory, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    low = rows(customer, F.expr("concat('c', c_custkey)"), "c_name", "county", code, area, 2, F.expr("c_custkey % 2 = 0"), F.expr("c_custkey % 3 = 0"), "x0 + c_custkey % 16", "(c_custkey div 16) % 128", "x0 + c_custkey % 16 + 1", "(c_custkey div 16) % 128 + 1")
    return _geometry(top.unionByName(middle).unionByName(low))


def natural(spark, directory: str) -> DataFrame:
    """Natural features from part, with boxes."""
    part = table(spark, directory, "part")
    kinds = F.array(*[F.lit(k) for k in NATURAL])
    df = part.select(
        F.expr("concat('ne_', p_partkey)").alias("id"), F.lit("boxes").alias("source_layer"), F.struct(F.col("p_name").alias("primary"), F.col("p_name").alias("en")).alias("names"), F.get(kinds, (F.col("p_partkey") % 8).cast("int")).alias("subtype"), F.lit(None).cast("string").alias("class"),
        F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("int").alias("admin_level"), F.expr("p_partkey % 8 > 1").alias("is_land"), F.lit(None).cast("boolean").alias("is_territorial"),
        F.expr(f"cast(if({WIDE}, (37 * p_partkey) % 320 div 16 * 16, (37 * p_partkey) % if(p_partkey % 8 < 2, 320, 640)) as double)").alias("xmin"), F.expr(f"cast(if({WIDE}, 0, (53 * p_partkey) % 128) as double)").alias("ymin"),
        F.expr(f"cast(if({WIDE}, (37 * p_partkey) % 320 div 16 * 16 + 32, (37 * p_partkey) % if(p_partkey % 8 < 2, 320, 640) + 1 + p_size % 16) as double)").alias("xmax"), F.expr(f"cast(if({WIDE}, 128, (53 * p_partkey) % 128 + 1 + p_size % 8) as double)").alias("ymax"),
    )
    return _geometry(df)
