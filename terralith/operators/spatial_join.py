"""Joins on spatial predicates.

Every feature gets the level of a grid hierarchy at which a cell is at least as large as its box, so it meets at most four cells of it,
be it a hamlet or a continent. Two features meet in a cell of the coarser one's level: the finer one also registers in the
cells above its own, at the levels that the other side uses. The equality join on (level, cell) is salted where cells are hot. A pair is kept only
in the cell that holds the lower corner of the boxes' overlap, so no distinct is needed; then boxes are compared, then the
predicate runs. A side that a count proves small is broadcast instead. Where many features share their geometries, each pair of different
geometries is tested once and the features are joined to the pairs that passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import call, register
from terralith.operators.joins import salted_join
from terralith.session import cut
from terralith.sources.gazetteer import BOX, with_box

#: Side of a cell at level 0 and the number of levels.
BASE, DEEPEST = 1024.0, 24
#: A side of at most so many rows, and bytes of geometry, is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000, 32 << 20
#: Features per different geometry from which pairs of geometries are tested instead of pairs of features, and rows of the result that one task may make of a geometry.
SHARED, HOT_PAIRS = 2, 2_000_000
#: Rows of the result that a task makes of many geometries, about: these take the time, not the few bytes that they come from.
TASK_PAIRS = 8_000_000

#: Predicates of (left, right): whether the boxes must overlap, and the exact test.
PREDICATES = {
    "intersects": lambda a, b: call("st_intersects", a, b),
    "touches": lambda a, b: call("st_touches", a, b),
    "within": lambda a, b: call("st_within", a, b),
    "contains": lambda a, b: call("st_contains", a, b),
    "overlaps": lambda a, b: call("st_crossing", a, b),
    "boxes": lambda a, b: F.lit(True),
}


def boxes_meet(a: str, b: str) -> Column:
    """Box comparison of two sides whose columns have the prefixes a and b: native, and first in any condition."""
    return (F.col(f"{a}xmin") <= F.col(f"{b}xmax")) & (F.col(f"{b}xmin") <= F.col(f"{a}xmax")) & (F.col(f"{a}ymin") <= F.col(f"{b}ymax")) & (F.col(f"{b}ymin") <= F.col(f"{a}ymax"))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def _level(p: str) -> Column:
    extent = F.greatest(F.col(f"{p}xmax") - F.col(f"{p}xmin"), F.col(f"{p}ymax") - F.col(f"{p}ymin"), F.lit(BASE / 2**DEEPEST))
    return F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.floor(F.log2(F.lit(BASE) / extent)))).cast("int")


def _cells(df: DataFrame, p: str, levels: str) -> DataFrame:
    """A row for each level in the array `levels` and cell of it that the box meets."""
    df = df.withColumn("_level", F.explode(F.expr(levels))).withColumn("_size", F.lit(BASE) / F.pow(F.lit(2.0), F.col("_level")))
    for axis in "xy":
        df = df.withColumn(f"_{axis}", F.explode(F.sequence(F.floor(F.col(f"{p}{axis}min") / F.col("_size")), F.floor(F.col(f"{p}{axis}max") / F.col("_size")))))
    return df.withColumn("_cell", F.concat_ws("/", "_level", "_x", "_y"))


def _fits(side: DataFrame, p: str) -> bool:
    """Whether a side is small enough to be broadcast; looks no further than BROADCAST_ROWS rows."""
    rows, size = side.select(F.octet_length(f"{p}geometry").alias("b")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _shared(side: DataFrame, p: str) -> bool:
    """Whether a side has at least SHARED features for each different geometry, about."""
    rows, different = side.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(f"{p}geometry"))).first()
    return rows >= SHARED * different


def _tested(pairs: DataFrame, predicate: str) -> DataFrame:
    """Pairs that pass the exact test; with the name of their relation where that is asked for."""
    if predicate == "relation":
        return pairs.withColumn("relation", call("st_relation", "l_geometry", "r_geometry")).where("relation is not null")
    return pairs.where(PREDICATES[predicate]("l_geometry", "r_geometry"))


def _grid_pairs(ls: DataFrame, rs: DataFrame, test: Column) -> DataFrame:
    """Pairs of two sides, with the prefixes l_ and r_, whose boxes meet and that pass the native `test`."""
    ls, rs = ls.withColumn("_own", _level("l_")), rs.withColumn("_own", _level("r_"))
    used = {s: sorted(r[0] for r in df.select("_own").distinct().collect()) for s, df in (("l", ls), ("r", rs))}  # at most DEEPEST + 1 numbers
    above = {s: f"filter(cast(array({', '.join(map(str, used[o]))}) as array<int>), v -> v < _own)" for s, o in (("l", "r"), ("r", "l"))}
    here = [F.floor(F.greatest(f"l_{a}min", f"r_{a}min") / F.col("_size")) == F.col(f"_{a}") for a in "xy"]
    # cells of a feature's own level meet own cells and the cells above finer features; cells above never meet each other
    own_l, up_l = _cells(ls, "l_", "array(_own)"), _cells(ls, "l_", above["l"])
    own_r, any_r = _cells(rs, "r_", "array(_own)"), _cells(rs, "r_", f"array_append({above['r']}, _own)")
    grid = ["_level", "_size", "_x", "_y", "_own"]
    pairs = salted_join(own_l, any_r.drop(*grid), "_cell").where(here[0] & here[1] & test).drop("_cell", *grid)
    return pairs.unionByName(salted_join(up_l, own_r.drop(*grid), "_cell").where(here[0] & here[1] & test).drop("_cell", *grid))


def _shape(p: str) -> Column:
    """128 bits that stand for a geometry and its box: boxes may be given, and features that share a geometry, but not its box, stay apart."""
    return F.unhex(F.md5(F.concat(F.col(f"{p}geometry"), F.encode(F.concat_ws(" ", *[f"{p}{c}" for c in BOX]), "utf-8")))).alias("_shape")


def _shapes(side: DataFrame, p: str) -> DataFrame:
    """The different geometries of a side, with their features' number `_n`."""
    columns = ["geometry", *BOX]
    return cut(side.select(_shape(p), *[F.col(p + c).alias(c) for c in columns]).groupBy("_shape", *columns).agg(F.count("*").alias("_n")))


def _shape_pairs(ls: DataFrame, rs: DataFrame, predicate: str, condition: Column | None, same: bool) -> DataFrame:
    """The join by different geometries: these are paired and tested, then the features of each are joined to the pairs. Grows with the result only, however many features share a geometry."""
    l_shapes = _shapes(ls, "l_")
    r_shapes = l_shapes if same else _shapes(rs, "r_")
    met = _tested(_grid_pairs(_prefixed(l_shapes, "l_"), _prefixed(r_shapes, "r_"), boxes_meet("l_", "r_")), predicate)
    met = cut(met.select("l__shape", "r__shape", "l__n", "r__n", *[c for c in met.columns if c == "relation"]))
    rows = met.groupBy("r__shape").agg((F.sum("l__n") * F.first("r__n")).alias("_n"))
    tasks = -(-int(rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]) // TASK_PAIRS)
    counts = l_shapes.select(F.col("_shape").alias("l__shape"), "_n")
    left = salted_join(ls.select(_shape("l_").alias("l__shape"), *ls.columns), met.drop("l__n", "r__n"), "l__shape", counts=counts).drop("l__shape")
    pairs = salted_join(left, rs.select(_shape("r_").alias("r__shape"), *rs.columns), "r__shape", HOT_PAIRS, rows, tasks if tasks > 1 else None).drop("r__shape")
    return pairs if condition is None else pairs.where(condition)


def spatial_pairs(left: DataFrame, right: DataFrame, predicate: str, condition: Column | None = None) -> DataFrame:
    """Inner join: columns of `left` prefixed l_, of `right` prefixed r_. Both need geometry; boxes are added if missing.

    `condition` is a further native condition on prefixed columns, tested before the predicate unless features share their geometries. Features without a geometry
    join nothing. The predicate "relation" takes all that meet and adds how, as `relation` (see st_relation).
    """
    spark = left.sparkSession
    register(spark)
    ls, rs = [_prefixed(with_box(side).where(F.col("geometry").isNotNull()), p) for side, p in ((left, "l_"), (right, "r_"))]
    ls, rs = ls.where("l_xmin is not null"), rs.where("r_xmin is not null")
    test = boxes_meet("l_", "r_")
    if condition is not None:
        test = test & condition
    if _fits(rs, "r_"):
        return _tested(ls.join(F.broadcast(rs), test), predicate)
    if left is not right and _fits(ls, "l_"):
        return _tested(rs.join(F.broadcast(ls), test), predicate)
    same = left is right
    if _shared(ls, "l_") or not same and _shared(rs, "r_"):
        return _shape_pairs(ls, rs, predicate, condition, same)
    return _tested(_grid_pairs(ls, rs, test), predicate)


def by_shape(features: DataFrame, predicate: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a symmetric predicate that no geometry fulfils with itself: the features, with a box and what stands for their geometry and it (`_shape`), the number `_n` of
    each shape's features, and the pairs (s_shape, _shape) of shapes that pass, both ways round."""
    placed = with_box(features.where(F.col("geometry").isNotNull())).where("xmin is not null")
    placed = placed.select(_shape(""), *placed.columns)
    shapes = _shapes(placed, "")
    met = spatial_pairs(shapes, shapes, predicate, F.col("l__shape") < F.col("r__shape"))
    met = cut(met.select(F.explode(F.array(*[F.struct(F.col(f"{a}__shape").alias("s_shape"), F.col(f"{b}__shape").alias("_shape")) for a, b in ("lr", "rl")])).alias("_pair")).select("_pair.*"))
    return placed, shapes.select("_shape", "_n"), met


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, how: str = "inner", key: str = "id", condition: Column | None = None) -> DataFrame:
    """`how` is inner (see spatial_pairs), left_semi or left_anti: rows of `left`, whole, with or without a partner.

    Semi and anti joins go by the left rows' `key`; rows with a null key have no partner.
    """
    if how == "inner":
        return spatial_pairs(left, right, predicate, condition)
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"how must be inner, left_semi or left_anti, not {how}")
    keep = [c for c in (key, "geometry", *BOX) if c in left.columns]
    needed = right.select(*[c for c in ("geometry", *BOX) if c in right.columns]) if condition is None else right
    met = spatial_pairs(left.select(*keep) if condition is None else left, needed, predicate, condition).select(F.col(f"l_{key}").alias("_met")).distinct()
    return left.join(met, F.col(key) == F.col("_met"), how)
