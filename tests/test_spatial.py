import random

import pytest
from pyspark.sql import functions as F

from terralith.functions import call, register, union_of
from terralith.operators import cells, joins, relations, spatial_join
from terralith.operators.spatial_join import spatial_join as join
from terralith.operators.spatial_join import spatial_pairs
from terralith.sources.gazetteer import with_box


def boxes(spark, n, seed, span=60, sizes=(1, 2, 9, 40)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.randrange(-span, span), rng.randrange(-span, span), rng.choice(sizes), rng.choice(sizes)
        rows.append((f"b{i}", float(x), float(y), float(x + w), float(y + h)))
    register(spark)
    return spark.createDataFrame(rows, "id string, xmin double, ymin double, xmax double, ymax double").withColumn("geometry", call("st_makeenvelope", "xmin", "ymin", "xmax", "ymax"))


def plain(a, b, how):
    meets = a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    overlaps = a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]
    within = lambda p, q: p[1] >= q[1] and p[3] <= q[3] and p[2] >= q[2] and p[4] <= q[4]
    return {"intersects": meets, "touches": meets and not overlaps, "within": within(a, b), "contains": within(b, a), "overlaps": overlaps and not within(a, b) and not within(b, a)}[how]


@pytest.mark.parametrize("how", ["intersects", "touches", "within", "contains", "overlaps"])
def test_grid_join_equals_all_pairs(spark, monkeypatch, how):
    monkeypatch.setattr(spatial_join, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    a, b = boxes(spark, 130, 1), boxes(spark, 110, 2)
    expected = sorted((x["id"], y["id"]) for x in a.collect() for y in b.collect() if plain(x, y, how))
    got = sorted((r["l_id"], r["r_id"]) for r in spatial_pairs(a, b, how).collect())
    assert got == expected and expected
    semi = {r["id"] for r in join(a, b, how, "left_semi").collect()}
    anti = {r["id"] for r in join(a, b, how, "left_anti").collect()}
    assert semi == {x for x, _ in expected} and len(semi) + len(anti) == 130 and not semi & anti


def test_broadcast_path_and_empty_sides(spark):
    a = boxes(spark, 40, 3)
    assert spatial_pairs(a, a, "intersects", F.col("l_id") < F.col("r_id")).count() == sum(plain(x, y, "intersects") for x in a.collect() for y in a.collect() if x["id"] < y["id"])
    assert spatial_pairs(a, a.where("false"), "intersects").count() == 0
    assert join(a, a.where("false"), "intersects", "left_anti").count() == 40
    with pytest.raises(ValueError):
        join(a, a, "intersects", "full")


def test_features_without_geometry_join_nothing(spark):
    a = boxes(spark, 20, 4).withColumn("geometry", F.when(F.col("id") != "b1", F.col("geometry"))).drop("xmin", "ymin", "xmax", "ymax")
    assert spatial_pairs(a, a, "intersects").where("l_id = 'b1' or r_id = 'b1'").count() == 0
    assert with_box(a).where("id = 'b1'").first()["xmin"] is None


def test_salted_join_is_a_join(spark):
    many = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id % 50 as string) end as k")
    few = spark.range(50).selectExpr("cast(id as string) as k", "id as v").union(spark.sql("select 'hot', 99L"))
    plain = sorted(map(tuple, many.join(few, "k").collect()))
    assert sorted(map(tuple, joins.salted_join(many, few, "k", hot_rows=20).select("k", "id", "v").collect())) == plain


def test_hot_keys_beside_maps(spark):
    many = spark.range(300).selectExpr("id", "id % 3 as k", "named_struct('primary', 'x', 'common', map('en', cast(id as string))) as names")
    few = spark.sql("select 0L as k, 'v' as v union all select 2L, 'w'")
    got = joins.salted_join(many, few, "k", hot_rows=20).select("id", "v", "names.common.en").collect()
    assert sorted((r[0], r[1], int(r[2])) for r in got) == sorted((i, "vxw"[i % 3], i) for i in range(300) if i % 3 != 1)


def crowd(spark, n, seed):
    """Named divisions of which many lie on few boxes."""
    rng = random.Random(seed)
    rows = [(f"c{i}", (f"name {i}", {"en": f"name {i}"}), rng.choice(("region", "county")), "A", *(lambda x, y: (float(x), float(y), x + 1.0, y + 1.0))(rng.randrange(5), rng.randrange(4))) for i in range(n)]
    rows += [("c_wide", ("wide", {}), "country", "A", 1.0, 1.0, 4.0, 3.0), ("c_part", ("part", {}), "region", "A", 0.5, 0.5, 1.5, 1.5)]
    register(spark)
    made = spark.createDataFrame(rows, "id string, names struct<primary: string, common: map<string, string>>, subtype string, country string, xmin double, ymin double, xmax double, ymax double")
    return made.withColumn("geometry", call("st_makeenvelope", "xmin", "ymin", "xmax", "ymax"))


@pytest.mark.parametrize("how", ["touches", "within", "overlaps"])
def test_shared_geometries_are_tested_once(spark, monkeypatch, how):
    monkeypatch.setattr(spatial_join, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(spatial_join, "HOT_PAIRS", 40)
    monkeypatch.setattr(joins, "HOT_ROWS", 4)
    d = crowd(spark, 120, 8)
    tested = []
    exact = spatial_join._tested
    monkeypatch.setattr(spatial_join, "_tested", lambda pairs, p: tested.append(pairs.count()) or exact(pairs, p))
    rows = [(r["id"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in d.collect()]
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and plain(a, b, how))
    assert sorted((r["l_id"], r["r_id"]) for r in spatial_pairs(d, d, how, F.col("l_id") < F.col("r_id")).collect()) == expected and expected
    assert sum(tested) <= 22 * 22  # 22 different boxes, 122 features


@pytest.mark.parametrize("hot", [40, 1_000_000])
def test_tasks_share_the_rows_that_they_make(spark, monkeypatch, hot):
    """The join of features that share geometries has tasks by the rows of its result, not by the bytes that it reads."""
    monkeypatch.setattr(spatial_join, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(spatial_join, "HOT_PAIRS", hot)
    monkeypatch.setattr(spatial_join, "TASK_PAIRS", 5)
    d = crowd(spark, 120, 8)
    rows = [(r["id"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in d.collect()]
    expected = sorted((a[0], b[0]) for a in rows for b in rows if plain(a, b, "overlaps"))
    pairs = spatial_pairs(d, d, "overlaps").select("l_id", "r_id")
    assert pairs.rdd.getNumPartitions() >= -(-len(expected) // 5) > 10
    assert sorted(map(tuple, pairs.collect())) == expected


def test_adjacency_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_ROWS", 4)
    d = crowd(spark, 60, 9)
    rows = [(r["id"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in d.collect()]
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and plain(a, b, "touches"))
    for shared in (2, 1000):  # by geometries, then by features
        monkeypatch.setattr(spatial_join, "SHARED", shared)
        assert sorted((r["anchor_id"], r["target_id"]) for r in relations.adjacency(d).collect()) == expected


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(50)] + [(f"q{i}", rng.uniform(10, 10.05), rng.uniform(-0.02, 0.03)) for i in range(150)]
    rows += [("same1", 10.0, 0.0), ("same2", 10.0, 0.0), ("edge1", 180.0, 90.0), ("edge2", 179.995, 89.999), (None, 1.0, 1.0), ("null", None, 1.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    whole = [r for r in rows if r[0] and r[1] is not None]
    expected = sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(whole) for b in whole[:i] if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < 1e-4)
    assert sorted((r["id_1"], r["id_2"]) for r in cells.near_pairs(df, 0.01).collect()) == expected
    assert cells.near_pairs(df.where("false"), 0.01).count() == 0
    with pytest.raises(ValueError):
        cells.near_pairs(df, 0)


def test_points_in_regions(spark):
    register(spark)
    shapes = [
        ("plain", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"), ("hole", "POLYGON ((20 0, 50 0, 50 30, 20 30, 20 0), (30 10, 40 10, 40 20, 30 20, 30 10))"), ("two", "MULTIPOLYGON (((-20 -20, -10 -20, -10 -10, -20 -10, -20 -20)), ((60 60, 61 60, 61 61, 60 60)))"),
        ("filled", "MULTIPOLYGON (((100 0, 130 0, 130 30, 100 30, 100 0), (110 10, 120 10, 120 20, 110 20, 110 10)), ((110 10, 120 10, 120 20, 110 20, 110 10)))"), ("line", "LINESTRING (0 0, 5 5)"), ("empty", "POLYGON EMPTY"), ("bad", None),
    ]
    regions = spark.createDataFrame(shapes, "region_id string, t string").select("region_id", call("st_geomfromtext", "t").alias("geometry"))
    rng = random.Random(8)
    points = [(f"p{i}", rng.uniform(-30, 140), rng.uniform(-30, 65)) for i in range(600)]
    df = spark.createDataFrame(points, "id string, x double, y double")
    brute = regions.crossJoin(df).where(call("st_holds_point", "geometry", "x", "y")).select("region_id", "id")
    got = sorted(map(tuple, cells.inside_pairs(df, regions).collect()))
    assert got == sorted(map(tuple, brute.collect()))
    assert {r for r, _ in got} == {"plain", "hole", "two", "filled"} - ({"two"} - {r for r, _ in got})
    inside_hole = {i for i, x, y in points if 30 < x < 40 and 10 < y < 20}
    assert not inside_hole & {i for r, i in got if r == "hole"}
    assert {i for i, x, y in points if 110 < x < 120 and 10 < y < 20} <= {i for r, i in got if r == "filled"}


def test_locations(spark):
    register(spark)
    rows = [(" A1 ", "POINT (1 2)"), ("a1", "POINT (1 2)"), ("b", "POLYGON ((0 0, 2 0, 2 4, 0 0))"), ("c", "POINT (200 0)"), ("d", "POLYGON EMPTY"), ("e", None), (None, "POINT (0 0)")]
    df = spark.createDataFrame(rows, "id string, t string").select("id", call("st_geomfromtext", "t").alias("geometry"), F.lit(1).alias("x"))
    assert sorted(map(tuple, cells.locate(df).collect())) == [("a1", 1.0, 2.0), ("b", 1.0, 2.0)]


def test_range_join(spark):
    points = spark.range(0, 400).select(F.col("id").alias("code"))
    ranges = spark.createDataFrame([(0, 10), (5, 5), (100, 350), (399, 1000)], "lo long, hi long")
    got = sorted(map(tuple, cells.range_join(points, ranges, 4).select("code", "lo").collect()))
    assert got == sorted((c, lo) for c in range(400) for lo, hi in ((0, 10), (5, 5), (100, 350), (399, 1000)) if lo <= c <= hi)


def test_relation_limits():
    limits = relations.relation_limits({"adjacency": 100, "containment": 10}, 2, 1.5, {"intersection": 7})
    assert limits["adjacency"] == 300 and limits["common_neighbor"] == 900 and limits["containment"] == 30 and limits["intersection"] == 7 and limits["coastal_containment"] == 500
    assert relations.relation_limits({"buffer": 10, "set_operations": 10}, 2, 1.5)["adjacency"] == 30 and relations.per_combination_limit(12_000, 3, 100, 1_500) == 1_500
    assert relations.capped({"containment": 99_999, "adjacency": 3})["containment"] == 12_000
    assert relations.needs_rebuild(["A"], ["A"]) is False and relations.needs_rebuild(["all"], ["all"]) is True


def test_union_of_parts(spark):
    register(spark)
    rows = spark.range(300).select(call("st_makeenvelope", F.col("id").cast("double"), F.lit(0.0), F.col("id") + 1.5, F.lit(2.0)).alias("geometry"))
    assert abs(union_of(rows).select(call("st_area", "g").alias("a")).first()["a"] - 601.0) < 1e-9
    assert union_of(rows.where("false")).first()["g"] is None


def test_relation_from_one_matrix(spark):
    register(spark)
    box = lambda *c: call("st_makeenvelope", *[F.lit(float(x)) for x in c])
    cases = {"touches": (box(0, 0, 1, 1), box(1, 0, 2, 1)), "within": (box(1, 1, 2, 2), box(0, 0, 3, 3)), "contains": (box(0, 0, 3, 3), box(1, 1, 2, 2)), "intersects": (box(0, 0, 2, 2), box(1, 1, 3, 3)), None: (box(0, 0, 1, 1), box(5, 5, 6, 6))}
    for expected, (a, b) in cases.items():
        assert spark.range(1).select(call("st_relation", a, b).alias("r")).first()["r"] == expected


def test_cross_source_of_shared_geometries(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_ROWS", 4)
    monkeypatch.setattr(spatial_join, "HOT_PAIRS", 40)
    d = crowd(spark, 60, 10)
    n = crowd(spark, 50, 11).where("subtype = 'county'").withColumn("subtype", F.lit("Lake"))
    n = n.withColumn("id", F.concat(F.lit("ne_"), "id"))
    kind = lambda a, b: next((k for k in ("touches", "within", "contains", "intersects") if plain(a, b, k)), None)
    left, right = ([(r["id"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in x.collect()] for x in (d, n))
    expected = sorted((a[0], b[0], kind(a, b)) for a in left for b in right if kind(a, b))
    assert sorted((r["division_id"], r["natural_id"], r["relation_type"]) for r in relations.cross_source(d, n).collect()) == expected and expected


def test_limited_cross_source_stops_when_combinations_are_full(spark, monkeypatch):
    monkeypatch.setattr(relations, "FIRST_PART", 2)
    d = crowd(spark, 40, 12)
    n = crowd(spark, 200, 13).where("subtype = 'county'").withColumn("subtype", F.when(F.col("id") < "c2", "lake").otherwise("river"))
    rows = sorted((r["division_subtype"], r["natural_subtype"], r["division_id"], r["natural_id"], r["relation_type"]) for r in relations.cross_source(d, n).collect())
    expected = [r for i, r in enumerate(rows) if sum(q[:2] == r[:2] for q in rows[:i]) < 2]
    joined = []
    related = relations._related
    monkeypatch.setattr(relations, "_related", lambda a, b: joined.append(a.count()) or related(a, b))
    got = sorted((r["division_subtype"], r["natural_subtype"], r["division_id"], r["natural_id"], r["relation_type"]) for r in relations.cross_source(d, n, per_combination=2).collect())
    assert got == expected and sum(joined) < d.count()


def test_common_neighbours_need_no_distinct_of_all_pairs(spark):
    edge = lambda a, b: tuple(x for i in (a, b) for x in (i, f"name {i}", "county")) + ("adjacent",)
    edges = [edge("a", "m"), edge("a", "m"), edge("b", "m"), edge("c", "m"), edge("a", "b")]
    adjacent = spark.createDataFrame(edges, "anchor_id string, anchor_name string, anchor_subtype string, target_id string, target_name string, target_subtype string, relation_type string")
    out = relations.common_neighbor(adjacent)
    assert sorted((r["anchor_id_1"], r["anchor_id_2"], r["shared_neighbor_id"]) for r in out.collect()) == [("a", "b", "m"), ("a", "c", "m"), ("a", "m", "b"), ("b", "c", "m"), ("b", "m", "a")]
    assert out._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"


def test_common_neighbours_list_edges_by_geometry(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 40)
    monkeypatch.setattr(relations, "TASK_PAIRS", 200, raising=False)
    monkeypatch.setattr(relations, "LEAST_PART", 5, raising=False)
    d = crowd(spark, 80, 14)
    # an id with two geometries, one with two names, and a feature given twice
    moved = d.where("id = 'c3'").withColumn("xmin", F.col("xmin") + 2).withColumn("xmax", F.col("xmax") + 2).withColumn("geometry", call("st_makeenvelope", "xmin", "ymin", "xmax", "ymax"))
    renamed = d.where("id = 'c4'").withColumn("names", F.struct(F.lit("other").alias("primary")))
    d = d.unionByName(moved).unionByName(renamed, allowMissingColumns=True).unionByName(d.where("id = 'c5'"))
    rows = {(r["id"], r["names"]["primary"], r["subtype"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in d.collect()}
    edges = {(a[:3], b[:3]) for a in rows for b in rows if a[0] != b[0] and plain((0, *a[3:]), (0, *b[3:]), "touches")}
    at = {}
    for a, s in edges:
        at.setdefault(s[0], []).append((a, s))
    expected = sorted({p + q + s for same in at.values() for p, s in same for q, _ in same if p[0] < q[0]})
    joined = []
    salted = relations.salted_join
    monkeypatch.setattr(relations, "salted_join", lambda many, *more, **options: joined.append(many.count()) or salted(many, *more, **options))
    out = relations.build(d, d, "common_neighbor")
    assert sorted(tuple(r) for r in out.collect()) == expected and expected
    assert 0 < max(joined) < len(edges)
