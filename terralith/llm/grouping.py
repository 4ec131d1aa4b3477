"""Problem 2: splits that keep related records together, by frontier breadth-first components.

Records and the things they share (features, authors, seeds) form a hypergraph. Its things are the nodes; a record that has
several joins them by a star of edges, so hot things never expand into pairs of records. A level of the search goes:

1. adjacency lists are hash-partitioned; every node that goes before its neighbours (more neighbours, then a hash) is a seed;
2. all seeds expand at once, `RINGS` rings deep; a node reached by several seeds keeps the smallest label, a node not reached
   is a seed of its own;
3. edges whose ends carry different labels are collisions: they are the edges of the next, much smaller graph, whose nodes
   are the labels.

Each component holds a seed (its smallest node at least), every level leaves at most one node for each seed, and the levels end when no collision
is left: the graph of colliding labels is merged by the same search, at every size. Labels of hot nodes are joined by
broadcast, all others by a shuffle on the node, so no task gathers a hot node's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.prefix import unit_hash
from terralith.operators.joins import salted_join
from terralith.session import cut, id_key, name_key, table

#: Rings a seed expands in one level.
RINGS = 2
#: A node with more edges than this is hot, and than a MOST_HOT-th of all: so there are at most MOST_HOT, few enough to broadcast.
HOT_DEGREE, MOST_HOT = 20_000, 50_000
LEVELS = 60


def _cut(df: DataFrame) -> DataFrame:
    return cut(df, iterated=True)


def _lookup(rows: DataFrame, labels: DataFrame, hot: DataFrame | None, node: str, out: str) -> DataFrame:
    """`rows` with the label `out` of column `node`; hot nodes' labels are broadcast (at most MOST_HOT)."""
    labels = labels.select(F.col("node").alias(node), F.col("label").alias(out))
    if hot is None:
        return rows.join(labels, node)
    few = labels.join(F.broadcast(hot.select(F.col("node").alias(node))), node, "left_semi")
    marked = rows.join(F.broadcast(few), node, "left")
    return marked.where(F.col(out).isNotNull()).unionByName(marked.where(F.col(out).isNull()).drop(out).join(labels, node))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (u, v: long); nodes have one label exactly if they are connected.

    Loops and repeated edges are allowed; rows with a null end are ignored; no edges give no rows.
    """
    edges = edges.where("u is not null and v is not null")
    both = _cut(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).distinct())
    pending = both.count()
    maps: list[DataFrame] = []
    for _ in range(LEVELS):
        if pending == 0:
            break
        degree = _cut(both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("d")))
        hot_at = max(HOT_DEGREE, pending // MOST_HOT)
        hot = degree.where(F.col("d") > hot_at).select("node")
        hot = hot if pending > hot_at and not hot.isEmpty() else None
        # the node of most neighbours goes first, so that a star falls to its centre and not its points; then a hash decides
        order = F.struct((-F.col("d")).alias("d"), F.xxhash64("node").alias("h"), "node")
        first = _lookup(both, degree.select("node", order.alias("label")), hot, "u", "p").groupBy("v").agg(F.min("p").alias("least"))
        nodes = _cut(degree.join(first, F.col("node") == F.col("v")).select("node", (order < F.col("least")).alias("seed")))
        reached = nodes.where("seed").select("node", F.col("node").alias("label"))
        for _ring in range(RINGS):
            # from the frontier outwards: a node takes the smallest label among its neighbours unless it has one
            found = _lookup(both, reached, hot, "u", "label").groupBy("v").agg(F.min("label").alias("label")).select(F.col("v").alias("node"), "label")
            fresh = found.join(reached.select("node"), "node", "left_anti")
            reached = _cut(reached.unionByName(fresh))
        labels = _cut(nodes.select("node").join(reached, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
        maps.append(labels)
        crossing = _lookup(_lookup(both, labels, hot, "u", "a"), labels, hot, "v", "b").where("a <> b")
        both = _cut(crossing.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        pending = both.count()
    else:
        raise RuntimeError(f"components not found in {LEVELS} levels")
    loops = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    if not maps:
        return loops.select("node", F.col("node").alias("label"))
    whole = maps[0]
    for step in maps[1:]:
        step = step.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        whole = whole.join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
    alone = loops.join(whole, "node", "left_anti").select("node", F.col("node").alias("label"))
    return whole.unionByName(alone)


def sample_links(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample ids and seed ids, distinct pairs of sample id and key): what samples share.

    A key is a selected feature ("f:" and its id), an author ("a:" and the letters and digits of the name), or a seed ("s:"
    and its id), which the seed itself has too. Null and blank values link nothing; candidates that are not selected don't
    count. All deliveries of an id count as one record.
    """
    chosen = F.transform("target.selected_candidates", lambda x: id_key(x))
    picked = F.filter("candidates", lambda c: F.array_contains(F.col("_chosen"), id_key(c["candidate_id"])))
    rows = samples.select(id_key(F.col("id")).alias("id"), chosen.alias("_chosen"), "candidates", name_key(F.col("metadata.author")).alias("author"), id_key(F.col("metadata.seed_id")).alias("seed")).where("id is not null")
    features = F.transform(F.filter(F.transform(picked, lambda c: id_key(c["id"])), lambda f: f.isNotNull() & (f != "")), lambda f: F.concat(F.lit("f:"), f))
    author = F.when(F.col("author").isNotNull(), F.concat(F.lit("a:"), F.col("author")))
    seed = F.when((F.col("seed") != "") & (F.col("seed") != F.col("id")), F.concat(F.lit("s:"), F.col("seed")))
    keys = F.filter(F.array_distinct(F.concat(F.coalesce(features, F.array().cast("array<string>")), F.array(author, seed))), lambda k: k.isNotNull())
    return rows.select("id", keys.alias("keys"))


def connected_samples(samples: DataFrame) -> DataFrame:
    """(sample_id, component, group_key, members) for every sample.

    Samples are linked by a shared selected feature, a shared author, or one being the other's existing seed. group_key is the
    smallest feature id selected in the component, null where none is; members counts its samples. A seed that no sample has
    as its id links nothing, not even two samples that both name it.
    """
    rows = cut(sample_links(samples))
    ids = rows.select("id").distinct()
    pairs = rows.select("id", F.explode("keys").alias("key"))
    seeds = pairs.where("key like 's:%'").select(F.substring("key", 3, 1 << 30).alias("seed")).distinct()
    there = seeds.join(ids, seeds["seed"] == ids["id"], "left_semi")
    # a seed may be named by a great part of all samples
    known = salted_join(pairs.where("key like 's:%'").withColumn("seed", F.substring("key", 3, 1 << 30)), there.select("seed"), "seed").select("id", "key")
    pairs = pairs.where("key not like 's:%'").unionByName(known).unionByName(there.select(F.col("seed").alias("id"), F.concat(F.lit("s:"), F.col("seed")).alias("key")))
    # a sample's keys are few; their numbers are 64-bit hashes
    stars = cut(pairs.groupBy("id").agg(F.collect_set(F.xxhash64("key")).alias("ks"), F.min(F.when(F.col("key").startswith("f:"), F.substring("key", 3, 1 << 30))).alias("feature")))
    stars = stars.withColumn("centre", F.array_min("ks"))
    edges = stars.select(F.col("centre").alias("u"), F.explode("ks").alias("v"))
    labels = components(edges.distinct())
    crowded = stars.groupBy("centre").agg(F.count("*").alias("n"), F.min("feature").alias("feature"))
    named = cut(crowded.join(labels, crowded["centre"] == labels["node"]).select("centre", "label", "n", "feature"))
    groups = named.groupBy("label").agg(F.sum("n").alias("members"), F.min("feature").alias("group_key"))
    # a hot centre is a row like any other here: one row for each centre, then one broadcast or shuffle join by centre
    by_centre = cut(named.select("centre", "label").join(groups, "label"))
    hot = named.where(F.col("n") > max(HOT_DEGREE, stars.count() // MOST_HOT)).select("centre")
    placed = stars.select("id", "centre")
    if hot.isEmpty():
        joined = placed.join(by_centre, "centre")
    else:
        hot = by_centre.join(F.broadcast(hot), "centre", "left_semi")
        marked = placed.join(F.broadcast(hot), "centre", "left")
        joined = marked.where("label is not null").unionByName(marked.where("label is null").select("id", "centre").join(by_centre, "centre"))
    joined = joined.select(F.col("id").alias("sample_id"), F.concat(F.lit("c"), F.hex("label")).alias("component"), "group_key", "members")
    rest = ids.join(stars.select("id"), "id", "left_anti")
    alone = rest.select(F.col("id").alias("sample_id"), F.concat(F.lit("i"), F.col("id")).alias("component"), F.lit(None).cast("string").alias("group_key"), F.lit(1).cast("long").alias("members"))
    return joined.unionByName(alone)


def split_components(members: DataFrame, shares: dict[str, float] | None = None, seed: int = 5) -> DataFrame:
    """Adds `split` to (sample_id, component, members): whole components, in the order of a hash, fill the splits in turn.

    A component goes to the split that its middle lies in when components are laid end to end in hash order, so the splits'
    sizes differ from their shares by at most the component that straddles a border. Components larger than the smallest
    share come first and go to the largest split: they fit nowhere else without emptying another split. Shares are taken in
    proportion to their sum; `shares` must hold a positive one.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    total = sum(shares.values())
    if total <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must be non-negative and not all 0")
    parts = 4096
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    sizes = cut(sizes.withColumn("h", unit_hash(F.lit(seed), F.col("component"))))
    everything = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()["all"]
    largest = max(shares, key=lambda s: shares[s])
    positive = [s for s in shares.values() if s > 0]
    giant = F.col("n") > min(positive) / total * everything
    giants = sizes.where(giant).select("component", F.lit(largest).alias("split"))
    in_giants = sizes.where(giant).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rest = sizes.where(~giant).withColumn("part", F.least(F.floor(F.col("h") * parts), F.lit(parts - 1)).cast("int"))
    from pyspark.sql import Window

    # the running sum over all components: first over `parts` sums, then inside each part
    sums = rest.groupBy("part").agg(F.sum("n").alias("s")).withColumn("one", F.lit(1))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = Window.partitionBy("part").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.join(F.broadcast(before), "part").withColumn("middle", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2)
    free = max(everything - in_giants, 1)
    room = {s: max(0.0, shares[s] / total * everything - (in_giants if s == largest else 0)) for s in shares}
    scale = free / max(sum(room.values()), 1e-9)
    choice, upto, names = None, 0.0, [s for s in shares if room[s] > 0] or [largest]
    for name in names[:-1]:
        upto += room[name] * scale
        choice = (F.when if choice is None else choice.when)(F.col("middle") < upto, name)
    rest = rest.select("component", (F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])).alias("split"))
    return salted_join(members, giants.unionByName(rest), "component")


def p2_found(spark, directory: str) -> DataFrame:
    """Every sample in a connected group of two or more, with the group's smallest selected feature id."""
    return connected_samples(table(spark, directory, "training_samples")).where("members > 1").select("sample_id", "group_key")


def p2_split(spark, directory: str) -> DataFrame:
    """Every sample with its component and split."""
    return split_components(connected_samples(table(spark, directory, "training_samples"))).select("sample_id", "component", "split")


def p2_report(spark, directory: str) -> DataFrame:
    """Samples, components and largest component of each split."""
    placed = split_components(connected_samples(table(spark, directory, "training_samples")))
    by = placed.groupBy("split", "component").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("samples"), F.count("*").alias("components"), F.max("n").alias("largest"))
    return by
