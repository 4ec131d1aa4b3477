"""The seven relation tables, each from one spatial join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.joins import salted_join
from terralith.operators.spatial_join import TASK_PAIRS, by_shape, spatial_join, spatial_pairs
from terralith.session import cut, exists
from terralith.sources.gazetteer import BOX, NATURAL_SUBTYPES

# Containment combinations, and default row limits of the tables.
CONTAINMENT = (("country", "region"), ("country", "county"), ("region", "county"))
LIMITS = {"adjacency": 50_000, "containment": 3_000, "intersection": 3_000, "cross_source": 1_800, "coastal_containment": 3_000, "landlocked_containment": 1_500, "common_neighbor": 5_000}
FALLBACK_LIMIT = 500
#: Rows of a containment combination when all countries are asked for.
MOST_PER_COMBINATION = 1_500
#: Divisions that a limited table joins at first, and by how much further parts grow.
FIRST_PART, PART_GROWTH = 8, 16
#: Anchors, times features of the shared geometry, that a part of a hot geometry's common neighbours holds at least.
LEAST_PART = 1_000
SEA = ("sea", "ocean")


def _named(features: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Named features with a geometry; of the given countries, unless these are None or hold "all"."""
    kept = features.where(F.col("geometry").isNotNull() & (F.trim("names.primary") != "")).withColumn("name", F.col("names.primary")).withColumn("subtype", F.lower("subtype"))
    return kept if not countries or "all" in countries else kept.where(F.col("country").isin(*countries))


def _first(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def adjacency(divisions: DataFrame, countries=None, limit: int | None = None) -> DataFrame:
    """Pairs of divisions that touch, once each (smaller id first)."""
    d = _named(divisions, countries)
    pairs = spatial_pairs(d, d, "touches", F.col("l_id") < F.col("r_id"))
    out = pairs.select(*[F.col(f"{p}_{c}").alias(f"{s}_{c}") for p, s in (("l", "anchor"), ("r", "target")) for c in ("id", "name", "subtype", "country")], F.lit("adjacent").alias("relation_type"))
    return _first(out, limit, "anchor_id", "target_id")


def containment(divisions: DataFrame, countries=None, per_combination: int | None = None, containers: DataFrame | None = None, kind: str = "containment") -> DataFrame:
    """Divisions within larger ones, for the three combinations of subtypes; at most `per_combination` rows of each, by ids.

    The limit holds for each combination, so that the many pairs of the finest one don't crowd out the others.
    """
    d = _named(divisions, countries).where(F.col("subtype").isin("country", "region", "county"))
    outer = (_named(containers, countries) if containers is not None else d).where("subtype in ('country', 'region')")
    combination = F.lit(False)
    for a, b in CONTAINMENT:
        combination = combination | ((F.col("r_subtype") == a) & (F.col("l_subtype") == b))
    pairs = spatial_pairs(d, outer, "within", combination & (F.col("l_id") != F.col("r_id")))
    out = pairs.select(*[F.col(f"{p}_{c}").alias(f"{s}_{c}") for p, s in (("r", "container"), ("l", "contained")) for c in ("id", "name", "subtype")], F.col("r_country").alias("container_country"), F.lit(kind).alias("relation_type"))
    if per_combination is None:
        return out
    w = Window.partitionBy("container_subtype", "contained_subtype").orderBy("container_id", "contained_id")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_combination).drop("_n")


def per_combination_limit(limit: int, combinations: int, least: int, most: int | None = None) -> int:
    share = max(limit // combinations, least)
    return share if most is None else min(share, most)


def sea_features(natural: DataFrame) -> DataFrame:
    return _named(natural).where(F.col("subtype").isin(*SEA))


def coastal_containment(divisions: DataFrame, natural: DataFrame, countries=None, per_combination: int | None = None) -> DataFrame:
    """Containment in divisions that meet a named sea or ocean."""
    outer = spatial_join(_named(divisions, countries).where("subtype in ('country', 'region')"), sea_features(natural), "intersects", "left_semi")
    return containment(divisions, countries, per_combination, outer, "coastal_containment")


def landlocked_containment(divisions: DataFrame, natural: DataFrame, countries=None, per_combination: int | None = None) -> DataFrame:
    """Containment in divisions that meet no named sea or ocean."""
    outer = spatial_join(_named(divisions, countries).where("subtype in ('country', 'region')"), sea_features(natural), "intersects", "left_anti")
    return containment(divisions, countries, per_combination, outer, "landlocked_containment")


def intersection(features: DataFrame, countries=None, limit: int | None = None) -> DataFrame:
    """Pairs whose interiors overlap without one lying within the other."""
    f = _named(features, countries)
    pairs = spatial_pairs(f, f, "overlaps", F.col("l_id") < F.col("r_id"))
    out = pairs.select(*[F.col(f"{p}_{c}").alias(f"{s}_{c}") for p, s in (("l", "anchor"), ("r", "target")) for c in ("id", "name", "subtype")], F.lit("intersects").alias("relation_type"))
    return _first(out, limit, "anchor_id", "target_id")


def _related(divisions: DataFrame, natural: DataFrame) -> DataFrame:
    pairs = spatial_pairs(divisions, natural, "relation")
    return pairs.select(*[F.col(f"l_{c}").alias(f"division_{c}") for c in ("id", "name", "subtype", "country")], *[F.col(f"r_{c}").alias(f"natural_{c}") for c in ("id", "name", "subtype")], F.col("relation").alias("relation_type"))


def _first_of_combinations(pairs: DataFrame, per_combination: int) -> DataFrame:
    w = Window.partitionBy("division_subtype", "natural_subtype").orderBy("division_id", "natural_id")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_combination).drop("_n")


def cross_source(divisions: DataFrame, natural: DataFrame, countries=None, per_combination: int | None = None) -> DataFrame:
    """Divisions and natural features that meet, by the first that holds of touches, within, contains, intersects.

    With a limit, divisions are joined in the order of their ids, in growing parts, until each combination of subtypes has its rows or no
    division is left: later divisions cannot be among a full combination's first rows.
    """
    d = _named(divisions, countries).where("subtype in ('country', 'region', 'county')").select("id", "name", "subtype", "country", "geometry", *[c for c in BOX if c in divisions.columns])
    n = _named(natural).where(F.col("subtype").isin(*NATURAL_SUBTYPES)).select("id", "name", "subtype", "geometry", *[c for c in BOX if c in natural.columns])
    if per_combination is None:
        return _related(d, n)
    n = cut(n.repartition("id"))  # read once for each part
    kinds = [r[0] for r in n.select("subtype").distinct().collect()]  # of NATURAL_SUBTYPES
    parts = []
    for subtype in ("country", "region", "county"):
        of, after, size, missing = d.where(F.col("subtype") == subtype), None, FIRST_PART, kinds
        while missing:
            rest = of if after is None else of.where(F.col("id") > after)
            last = rest.where("id is not null").select("id").orderBy("id").limit(size).agg(F.count("*"), F.max("id")).first()
            whole = last[0] < size
            part = rest if whole else rest.where((F.col("id") <= last[1]) | F.col("id").isNull())
            found = cut(_first_of_combinations(_related(part, n.where(F.col("subtype").isin(*missing))), per_combination))
            parts.append(found)
            if whole:
                break
            full = {r[0] for r in reduce(DataFrame.unionByName, parts).where(F.col("division_subtype") == subtype).groupBy("natural_subtype").count().where(F.col("count") >= per_combination).collect()}
            missing, after, size = [k for k in kinds if k not in full], last[1], size * PART_GROWTH
    return _first_of_combinations(reduce(DataFrame.unionByName, parts), per_combination) if parts else _first_of_combinations(_related(d, n), per_combination)


_ID3 = ("id", "name", "subtype")
_COMMON = [*[f"anchor_{c}_{i}" for i in (1, 2) for c in _ID3], *[f"shared_neighbor_{c}" for c in _ID3]]


def _common(edges: DataFrame) -> DataFrame:
    """Common neighbours from different edges (a_, s_), given both ways round."""
    one, two = [edges.select(*[F.col(f"a_{c}").alias(f"anchor_{c}_{i}") for c in _ID3], *([F.col(f"s_{c}").alias(f"shared_neighbor_{c}") for c in _ID3] if i == 1 else [F.col("s_id").alias("shared_neighbor_id")])) for i in (1, 2)]
    two = two.distinct()
    # a country or an ocean may touch a great part of all features
    return salted_join(one, two, "shared_neighbor_id").where("anchor_id_1 < anchor_id_2").select(*_COMMON)


def common_neighbor(adjacent: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs of features that touch the same third one, from an adjacency table."""
    side = lambda a, t: adjacent.select(*[F.col(f"{a}_{c}").alias(f"a_{c}") for c in _ID3], *[F.col(f"{t}_{c}").alias(f"s_{c}") for c in _ID3])
    # rows of the result hold both edges whole: edges given once give each row once
    edges = side("anchor", "target").unionByName(side("target", "anchor")).distinct()
    return _first(_common(edges), limit, "anchor_id_1", "anchor_id_2", "shared_neighbor_id")


def common_neighbor_of(divisions: DataFrame, countries=None, limit: int | None = None) -> DataFrame:
    """The same from the divisions, without their adjacent pairs: features of one geometry have the same neighbours, which are listed once for each geometry.

    An id with several names or geometries has the neighbours of all of these, so its edges are written out.
    """
    placed, shapes, met = by_shape(_named(divisions, countries), "touches")
    features = placed.where("id is not null").select("_shape", *_ID3).distinct()
    features = cut(features.withColumn("_once", F.count("*").over(Window.partitionBy("id")) == 1))
    once, several = features.where("_once").drop("_once"), features.where("not _once").drop("_once")
    repeated = not several.isEmpty()
    a_side = lambda f: salted_join(f, met, "_shape", counts=shapes).select("s_shape", *[F.col(c).alias(f"a_{c}") for c in _ID3])
    near = a_side(once).unionByName(a_side(several).distinct()) if repeated else a_side(once)
    # rows of the result by shared geometry; each part of a hot one is to hold so many anchors that copies of the others are few beside its rows
    size = met.join(shapes, "_shape").groupBy("s_shape").agg(F.sum("_n").cast("double").alias("_a")).join(shapes.withColumnRenamed("_shape", "s_shape"), "s_shape")
    rows = cut(size.select("s_shape", (F.col("_a") * F.col("_a") * F.col("_n") / 2).alias("_all"), (F.col("_a") * F.col("_n") * (TASK_PAIRS / LEAST_PART)).alias("_most")))
    tasks = -(-int(rows.agg(F.coalesce(F.sum("_all"), F.lit(0.0))).first()[0]) // TASK_PAIRS)
    one, two = [near.select("s_shape", *[F.col(f"a_{c}").alias(f"anchor_{c}_{i}") for c in _ID3]) for i in (1, 2)]
    shared = once.select(F.col("_shape").alias("s_shape"), *[F.col(c).alias(f"shared_neighbor_{c}") for c in _ID3])
    out = salted_join(one, two, "s_shape", TASK_PAIRS, rows.select("s_shape", F.least("_all", "_most").alias("_n")), tasks if tasks > 1 else None, shared).where("anchor_id_1 < anchor_id_2").select(*_COMMON)
    if repeated:
        edges = salted_join(near, several.select(F.col("_shape").alias("s_shape"), *[F.col(c).alias(f"s_{c}") for c in _ID3]), "s_shape").where("a_id <> s_id").drop("s_shape")
        out = out.unionByName(_common(edges.distinct()))
    return _first(out, limit, "anchor_id_1", "anchor_id_2", "shared_neighbor_id")


RELATIONS = ("adjacency", "containment", "intersection", "cross_source", "coastal_containment", "landlocked_containment", "common_neighbor")
# Which relations a family of questions draws its anchors from.
FAMILY_RELATIONS = {
    "direct_lookup": (), "adjacency": ("adjacency",), "multi_adjacency": ("adjacency", "common_neighbor"), "containment": ("containment",), "intersection": ("intersection", "cross_source"), "buffer": ("adjacency",),
    "chained": ("coastal_containment", "landlocked_containment", "containment"), "difference": ("containment", "cross_source"), "border_corridor": ("adjacency",), "set_operations": ("containment", "cross_source"),
    "partial_selection": ("containment", "cross_source"), "aggregation": ("containment",), "window_function": (), "attribute_filter": (),
}


def relation_limits(targets: dict[str, int], retry: float = 2.0, safety: float = 1.5, manual: dict[str, int] | None = None) -> dict[str, int]:
    """Rows each relation needs for so many wanted samples per family; relations nobody draws from get the fallback, manual limits win.

    Common neighbours come from the adjacency table, so their limit is three times its where no family asks for them.
    """
    need: dict[str, int] = {}
    for family, target in targets.items():
        for relation in FAMILY_RELATIONS.get(family, ()):
            need[relation] = need.get(relation, 0) + int(target * retry * safety)
    if "adjacency" in need:
        need.setdefault("common_neighbor", 3 * need["adjacency"])
    return {r: need.get(r, FALLBACK_LIMIT) for r in RELATIONS} | (manual or {})


def capped(limits: dict[str, int]) -> dict[str, int]:
    """Limits for a build over all countries: caps on the largest tables and a floor."""
    caps = {"containment": 12_000, "coastal_containment": 8_000, "landlocked_containment": 8_000}
    return {r: max(FALLBACK_LIMIT, min(n, caps.get(r, n))) for r, n in limits.items()}


def build(divisions: DataFrame, natural: DataFrame, relation: str, countries=None, limit: int | None = None, adjacent: DataFrame | None = None) -> DataFrame:
    """One relation table by name. ValueError for an unknown name."""
    most = MOST_PER_COMBINATION if countries and list(countries) == ["all"] else None
    if relation == "adjacency":
        return adjacency(divisions, countries, limit)
    if relation == "containment":
        return containment(divisions, countries, limit and per_combination_limit(limit, 3, 100, most))
    if relation == "coastal_containment":
        return coastal_containment(divisions, natural, countries, limit and per_combination_limit(limit, 3, 100, most))
    if relation == "landlocked_containment":
        return landlocked_containment(divisions, natural, countries, limit and per_combination_limit(limit, 3, 100, most))
    if relation == "intersection":
        return intersection(divisions, countries, limit)
    if relation == "cross_source":
        return cross_source(divisions, natural, countries, limit and per_combination_limit(limit, 51, 10))
    if relation == "common_neighbor":
        return common_neighbor_of(divisions, countries, limit) if adjacent is None else common_neighbor(adjacent, limit)
    raise ValueError(f"unknown relation {relation!r}; there are {', '.join(RELATIONS)}")


def build_all(divisions: DataFrame, natural: DataFrame, out: str, countries=None, limits: dict[str, int] | None = None) -> None:
    """Writes all relation tables to `<out>/<relation>_pairs`; common neighbours read the written adjacency table."""
    spark, limits = divisions.sparkSession, limits or LIMITS
    for relation in RELATIONS[:-1]:
        build(divisions, natural, relation, countries, limits.get(relation, FALLBACK_LIMIT)).write.mode("overwrite").parquet(f"{out}/{relation}.parquet")
    build(divisions, natural, "common_neighbor", countries, limits.get("common_neighbor", FALLBACK_LIMIT), spark.read.parquet(f"{out}/adjacency.parquet")).write.mode("overwrite").parquet(f"{out}/common_neighbor.parquet")


def load(spark, folder: str) -> dict[str, DataFrame]:
    """All relation tables of a folder that exist, by name; the folder may lie on any store."""
    paths = {name: f"{folder.rstrip('/')}/{name}.parquet" for name in RELATIONS}
    return {name: spark.read.parquet(path) for name, path in paths.items() if exists(spark, path)}


def needs_rebuild(built: list[str] | None, wanted: list[str]) -> bool:
    """Whether relations built for some countries must be built again for others; "all" on either side always rebuilds."""
    return built is None or "all" in built or "all" in wanted or set(built) != set(wanted)
