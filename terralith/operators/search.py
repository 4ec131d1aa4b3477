"""Finding places by name: Jaro-Winkler top-k over both sources, merging, distractors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import call, register

#: Candidates per source for so many places in one question; more places share five.
PER_SOURCE = {1: 5, 2: 4, 3: 3, 4: 2, 5: 2}
COLUMNS = ("source", "id", "name", "country", "subtype", "class", "region", "admin_level", "is_land", "is_territorial", "similarity")


def candidates_per_source(places: int) -> int:
    return PER_SOURCE.get(places) or max(1, math.ceil(5 / max(places, 1)))


def localised_name(source: str):
    """The name a source is searched by: divisions by their English name, natural features by the primary one."""
    return F.expr("names.common['en']") if source == "divisions_area" else F.col("names.primary")


def fuzzy_search(features: DataFrame, source: str, place: str, k: int, name=None) -> DataFrame:
    """The `k` features whose name is most like `place`, by Jaro-Winkler similarity of lower-case names.

    Features without a name are left out. Ties go to the smaller admin_level (nulls last), then the smaller id. A null or
    empty place has similarity null or 0 to everything. The order needs one pass and no sort of the table (top-k).
    """
    register(features.sparkSession)
    name = localised_name(source) if name is None else name
    rows = features.withColumn("name", name).where(F.trim("name") != "")
    rows = rows.withColumn("similarity", call("jaro_winkler_similarity", F.lower("name"), F.lower(F.lit(place)))).withColumn("source", F.lit(source))
    extra = ["division_id"] if "division_id" in features.columns else []
    return rows.select(*COLUMNS[:-1], *extra, "similarity").orderBy(F.desc("similarity"), F.asc_nulls_last("admin_level"), "id").limit(k)


def search_candidates(divisions: DataFrame, natural: DataFrame, place: str, k: int) -> DataFrame:
    """Top-k of both sources for one place."""
    return fuzzy_search(divisions, "divisions_area", place, k).unionByName(fuzzy_search(natural, "natural_earth", place, k), allowMissingColumns=True)


def merge_candidates(lists: list[DataFrame]) -> DataFrame:
    """Candidates of several places in one list: of repeated (source, id) the first place's row stays, even if another is more similar; then sorted."""
    numbered = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)]
    whole = numbered[0]
    for df in numbered[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    first = Window.partitionBy("source", "id").orderBy("_list", F.desc_nulls_last("similarity"))
    kept = whole.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.orderBy(F.desc_nulls_last("similarity"), F.asc_nulls_last("admin_level"), "_list", "source", "id").drop("_n", "_list")


def distractors(divisions: DataFrame, natural: DataFrame, anchor: str, anchor_source: str, anchor_id: str, n: int, cross_share: float = 0.5) -> DataFrame:
    """`n` features with names like `anchor`, other than it: max(1, round(n * cross_share)) of the other source, the rest of its own. Each id once."""
    cross = max(1, round(n * cross_share))
    frames = []
    for source, df in (("divisions_area", divisions), ("natural_earth", natural)):
        own = source == anchor_source
        if own:
            df = df.where(F.col("id") != anchor_id)
        once = df.where(F.trim("names.primary") != "").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("names.primary")))).where("_n = 1").drop("_n")
        frames.append(fuzzy_search(once, source, anchor, n - cross if own else cross, F.col("names.primary")))
    return frames[0].unionByName(frames[1], allowMissingColumns=True)


def interleave(lists: list[DataFrame], most: int, key=("source", "id")) -> DataFrame:
    """One list from several ranked ones (each with `position`): first places, then second ones, and so on; each key once, cut at `most` and renumbered c1, c2, ..."""
    whole = None
    for i, df in enumerate(lists):
        df = df.withColumn("_list", F.lit(i))
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    first = Window.partitionBy(*key).orderBy("position", "_list")
    kept = whole.withColumn("_n", F.row_number().over(first)).where("_n = 1").orderBy("position", "_list").limit(most)
    # at most `most` rows are left: one window over them is bounded
    numbered = kept.withColumn("_one", F.lit(1)).withColumn("rank", F.row_number().over(Window.partitionBy("_one").orderBy("position", "_list")))
    return numbered.withColumn("candidate_id", F.concat(F.lit("c"), F.col("rank").cast("string"))).drop("_n", "_one", "_list", "position")
