"""Problem 1: a sample that matches target category proportions, by hierarchical top-down allocation.

Categories are the inner nodes of a tree, which is an argument: request, group of kindred categories, category, leaf (the sample's template).
Quotas come down the tree. A group is given what its categories want and, of what other groups lack, a part in proportion to what it has to spare; within a
group, what one category lacks goes to its siblings. So unmet quota passes to siblings first, then to cousins; a category's quota is spread over its leaves. Rows are drawn at the leaves by their permuted dense
rank: the position of a row in the order of a seeded hash of its id. All allocation runs on counts per leaf, combined before
the shuffle; the draw never sorts a leaf in one task (see `prefix`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.canonical import pigeonhole_pairs
from terralith.llm.prefix import BROADCAST_GROUPS, take_prefix, unit_hash
from terralith.session import broadcast_if_small, cut, id_key, name_key, table

LEAF = "template_id"


def one_per_id(samples: DataFrame, *columns) -> DataFrame:
    """One row per sample id (trimmed, lower case): the values of its latest delivery. Rows without an id are dropped: they name no sample."""
    late = F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))), F.xxhash64(*columns))
    picked = samples.select(id_key(F.col("id")).alias("id"), late.alias("_late"), F.struct(*columns).alias("_row")).where("id is not null")
    return picked.groupBy("id").agg(F.max_by("_row", "_late").alias("_row")).select("id", "_row.*")


def category_keys(values: DataFrame, vocabulary: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Maps raw spellings to known categories: (dimension, raw) to `key`.

    values: distinct (dimension, raw); vocabulary: (dimension, key), keys as `name_key` makes them. Letter case, blanks,
    hyphens and abbreviations in `aliases` don't matter; other spellings get the single nearest key at most two edits away, or
    one for keys shorter than 8 letters; what stays unknown keeps its own key.
    """
    keyed = values.select("dimension", "raw", name_key(F.col("raw")).alias("_k"))
    if aliases:
        alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        keyed = keyed.select("dimension", "raw", F.coalesce(F.element_at(alias, F.col("_k")), F.col("_k")).alias("_k"))
    pairs = pigeonhole_pairs(keyed.select(F.col("_k").alias("value")), vocabulary.select(F.col("key").alias("ref")), 2)
    # a swap of neighbours is one slip but two edits
    swapped = (F.length("value") == F.length("ref")) & (F.array_sort(F.split("value", "")) == F.array_sort(F.split("ref", "")))
    pairs = pairs.where((F.col("distance") <= F.when((F.length("ref") >= 8) | swapped, 2).otherwise(F.when(F.length("ref") >= 5, 1).otherwise(0))))
    vocabulary = vocabulary.select("dimension", F.col("key").alias("ref")).distinct()
    best = keyed.join(pairs, F.col("_k") == F.col("value")).join(broadcast_if_small(vocabulary, BROADCAST_GROUPS), ["dimension", "ref"])
    best = best.groupBy("dimension", "raw").agg(F.min(F.struct("distance", "ref"))["ref"].alias("_near"))
    return keyed.join(best, ["dimension", "raw"], "left").select("dimension", "raw", F.coalesce("_near", "_k").alias("key"))


def _spread(frame: DataFrame, amount: str, weight: str, by: list[str], out: str) -> DataFrame:
    """Whole numbers `out` that sum, over the rows alike in `by`, to `amount`, in proportion to `weight`; the largest remainders round up, ties by name."""
    total = Window.partitionBy(*by)
    exact = F.when(F.sum(weight).over(total) > 0, F.col(amount) * F.col(weight) / F.sum(weight).over(total)).otherwise(0.0)
    frame = frame.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    frame = frame.withColumn("_left", F.col(amount) - F.sum("_floor").over(total))
    order = Window.partitionBy(*by).orderBy((F.col("_floor") - F.col("_exact")).asc(), F.col("_name"))
    return frame.withColumn(out, (F.col("_floor") + F.when((F.row_number().over(order) <= F.col("_left")) & (F.col("_exact") > F.col("_floor")), 1).otherwise(0)).cast("long")).drop("_exact", "_floor", "_left")


def allocate(wanted: DataFrame) -> DataFrame:
    """Adds `quota` to rows (request_id, group, key, have, want): what each category gives after unmet quota is passed on.

    A category gives at most what it has. Quotas come down: a group gets what it can give of its own want, and what other groups of the
    request lack is spread over the groups by what they have to spare; inside a group each category gets what it can give of its own want, and the
    rest is spread over the categories by what they have to spare. passed_on is what a category lacks, taken_over what it gives for others.
    """
    base, spare = F.least("have", "want"), F.greatest(F.col("have") - F.col("want"), F.lit(0))
    groups = wanted.groupBy("request_id", "group").agg(F.sum("have").alias("have"), F.sum("want").alias("want")).withColumn("_name", F.col("group"))
    request = Window.partitionBy("request_id")
    groups = groups.withColumn("_base", base).withColumn("_spare", spare).withColumn("_lack", F.greatest(F.col("want") - F.col("have"), F.lit(0)))
    groups = groups.withColumn("_pass", F.least(F.sum("_lack").over(request), F.sum("_spare").over(request)))
    groups = _spread(groups, "_pass", "_spare", ["request_id"], "_more").select(F.col("request_id").alias("_request"), F.col("group").alias("_group"), (F.col("_base") + F.col("_more")).alias("_given"))
    inside = Window.partitionBy("request_id", "group")
    out = wanted.join(groups, F.col("request_id").eqNullSafe(F.col("_request")) & (F.col("group") == F.col("_group"))).withColumn("_name", F.col("key")).withColumn("_base", base).withColumn("_spare", spare)
    out = out.withColumn("_pass", F.col("_given") - F.sum("_base").over(inside))
    out = _spread(out, "_pass", "_spare", ["request_id", "group"], "taken_over")
    out = out.withColumn("quota", F.col("_base") + F.col("taken_over")).withColumn("passed_on", F.greatest(F.col("want") - F.col("have"), F.lit(0)))
    return out.drop("_name", "_base", "_spare", "_pass", "_given", "_request", "_group")


class ProportionalSample:
    """Samples of `samples` per request of `targets`.

    tree: dimension (a field of `metadata`), group, categories of the group. aliases: other names of categories. Categories of a target that the tree
    lacks form a group of their own; categories that no target names are given nothing.
    targets: request_id, dimension (a field of `metadata`), category, target_share, min_rows, sample_fraction. With N distinct
    sample ids and n = floor(sample_fraction * N), a category wants max(min_rows, ceil(target_share * n)) rows. Null shares
    and minimums count as 0; rows of targets without a request, dimension or category, or with an unknown dimension, are
    reported with have = 0. Samples that lack the field belong to no category. Repeated ids count once.
    """

    def __init__(self, samples: DataFrame, targets: DataFrame, tree: dict[str, dict[str, list[str]]], aliases: dict[str, str] | None = None, seed: int = 17):
        self.seed, known = seed, [f.name for f in samples.schema["metadata"].dataType.fields]
        dimensions = [d for d in tree if d in known]
        rows = one_per_id(samples, *[F.col(f"metadata.{d}").alias(d) for d in dimensions], F.col(f"metadata.{LEAF}").alias("leaf"))
        self.rows = cut(rows)
        self.n = self.rows.count()
        long = self.rows.select("id", F.coalesce(name_key(F.col("leaf")), F.lit("")).alias("leaf"), F.expr(f"stack({len(dimensions)}, {', '.join(f"'{d}', `{d}`" for d in dimensions)}) as (dimension, raw)")).where("raw is not null")
        asked = targets.select("request_id", "dimension", "category", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), F.coalesce("sample_fraction", F.lit(0.0)).alias("fraction")).distinct()
        asked = asked.withColumn("key", F.coalesce(name_key(F.col("category")), F.lit("")))
        known_keys = [(d, "".join(ch for ch in c if ch.isalnum()), g) for d, groups in tree.items() for g, cs in groups.items() for c in cs]
        nodes = samples.sparkSession.createDataFrame(known_keys, "dimension string, key string, `group` string")
        vocabulary = nodes.select("dimension", "key").union(asked.select("dimension", "key")).distinct()
        spellings = cut(category_keys(long.select("dimension", "raw").distinct(), vocabulary, aliases))
        self.members = long.join(broadcast_if_small(spellings, BROADCAST_GROUPS), ["dimension", "raw"]).select("id", "dimension", "key", "leaf")
        self.leaves = cut(self.members.groupBy("dimension", "key", "leaf").agg(F.count("*").alias("rows")))
        have = self.leaves.groupBy("dimension", "key").agg(F.sum("rows").alias("have"))
        size = F.floor(F.round(F.col("fraction") * self.n, 6))
        wanted = asked.join(have, ["dimension", "key"], "left").join(nodes, ["dimension", "key"], "left")
        wanted = wanted.withColumn("have", F.coalesce("have", F.lit(0))).withColumn("group", F.coalesce("group", F.lit("other")))
        self.wanted = wanted.withColumn("size", size).withColumn("want", F.greatest(F.col("min_rows"), F.ceil(F.round(F.col("share") * F.col("size"), 6))).cast("long"))

    def report(self) -> DataFrame:
        """Per request and category: rows there are and wanted, the quota after passing on, and whether the target can be met."""
        out = allocate(self.wanted)
        return out.select("request_id", "dimension", "category", F.col("have").cast("long").alias("have"), "want", "quota", "passed_on", "taken_over", (F.col("have") >= F.col("want")).alias("met"))

    def draw(self) -> DataFrame:
        """The samples: request_id, category, id. A sample drawn for several requests comes out once for each."""
        quota = allocate(self.wanted).where("quota > 0").select("request_id", "dimension", "key", "category", F.col("quota").alias("_quota"))
        leaves = quota.join(self.leaves, ["dimension", "key"]).withColumn("_name", F.col("leaf"))
        leaves = _spread(leaves, "_quota", "rows", ["request_id", "dimension", "key", "category"], "quota")
        leaves = cut(leaves.select("request_id", "category", "dimension", "key", "leaf", "quota"))
        rows = self.members.join(broadcast_if_small(leaves.select("request_id", "category", "dimension", "key", "leaf"), BROADCAST_GROUPS), ["dimension", "key", "leaf"])
        rows = rows.withColumn("rank_key", unit_hash(F.lit(self.seed), F.col("request_id"), F.col("id")))
        return take_prefix(rows, leaves, ["request_id", "category", "dimension", "key", "leaf"], "rank_key", "id").select("request_id", "category", "id")


    def unmet(self) -> DataFrame:
        """Request and category of targets that the drawn sample falls short of, and that have too few rows."""
        drawn = self.draw().groupBy(F.col("request_id").alias("_request"), F.col("category").alias("_category")).agg(F.count("*").alias("drawn"))
        short = self.wanted.join(drawn, F.col("request_id").eqNullSafe(F.col("_request")) & F.col("category").eqNullSafe(F.col("_category")), "left").where(F.coalesce("drawn", F.lit(0)) < F.col("want"))
        return short.where("have < want").select("request_id", "category")


# Fixed values of the tables at hand: their categories, by dimension and group of kindred categories, and abbreviations in use.
TAXONOMY = {
    "task_family": {
        "lookup": ["direct_lookup", "disambiguation", "attribute_filter"],
        "topology": ["adjacency", "multi_adjacency", "containment", "intersection", "chained"],
        "construction": ["buffer", "difference", "border_corridor", "partial_selection", "set_operations"],
        "ranking": ["aggregation", "window_function"],
    },
    "sql_difficulty": {"plain": ["easy", "medium"], "involved": ["hard", "expert"]},
    "grounding_difficulty": {"plain": ["easy", "medium"], "involved": ["hard"]},
    "anchor_source": {"single": ["divisions_area", "natural_earth"], "several": ["mixed"]},
}
ALIASES = {"med": "medium", "mid": "medium", "diff": "hard", "ez": "easy"}


def _operator(spark, directory: str) -> ProportionalSample:
    return ProportionalSample(table(spark, directory, "training_samples"), table(spark, directory, "sample_targets"), TAXONOMY, ALIASES)


def p1_found(spark, directory: str) -> DataFrame:
    """Requested categories that cannot be met."""
    return _operator(spark, directory).unmet()


def p1_report(spark, directory: str) -> DataFrame:
    return _operator(spark, directory).report()


def p1_sample(spark, directory: str) -> DataFrame:
    return _operator(spark, directory).draw()
