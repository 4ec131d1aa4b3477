import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terralith import functions
from terralith.functions import call, register, st_union_agg

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
HOLED = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"


@pytest.fixture(scope="module")
def geo(spark):
    register(spark)

    def value(name, *texts, **extra):
        columns = [F.lit(None).cast("binary") if t is None else call("st_geomfromtext", F.lit(t)) if isinstance(t, str) else F.lit(t) for t in texts]
        return spark.range(1).select(call(name, *columns).alias("v")).first()["v"]

    return value


@pytest.mark.parametrize(
    "name, a, b, expected",
    [
        ("st_intersects", SQUARE, "POINT (4 4)", True), ("st_touches", SQUARE, "POINT (4 4)", True), ("st_touches", SQUARE, "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", True), ("st_touches", SQUARE, "POLYGON ((3 0, 8 0, 8 4, 3 4, 3 0))", False),
        ("st_within", "POINT (1 1)", SQUARE, True), ("st_within", "POINT (4 4)", SQUARE, False), ("st_contains", SQUARE, "POINT (1 1)", True), ("st_within", "POINT (4 4)", HOLED, False), ("st_intersects", "POINT (5 5)", HOLED, False),
        ("st_intersects", SQUARE, "POLYGON EMPTY", False), ("st_intersects", SQUARE, None, None), ("st_contains", HOLED, SQUARE, False), ("st_crossing", SQUARE, "POLYGON ((3 3, 6 3, 6 6, 3 6, 3 3))", True), ("st_crossing", SQUARE, "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", False),
    ],
)
def test_predicates(geo, name, a, b, expected):
    assert geo(name, a, b) is expected


def test_measures_and_boxes(geo):
    assert geo("st_area", SQUARE) == 16
    assert geo("st_area", HOLED) == 72
    assert geo("st_area", "LINESTRING (0 0, 3 4)") == 0
    assert [geo(f"st_{c}", "MULTIPOINT ((1 2), (5 -3))") for c in ("xmin", "ymin", "xmax", "ymax")] == [1, -3, 5, 2]
    assert geo("st_xmin", "POLYGON EMPTY") is None and geo("st_box", None) is None
    assert math.isclose(geo("st_area", "POLYGON ((0 0, 3 0, 3 2, 0 2, 0 0))"), 6)


def test_overlays(spark, geo):
    register(spark)
    a, b = call("st_geomfromtext", F.lit(SQUARE)), call("st_makeenvelope", 2, 2, 6, 6)
    row = spark.range(1).select(
        call("st_area", call("st_intersection", a, b)).alias("i"), call("st_area", call("st_difference", a, b)).alias("d"), call("st_area", call("st_buffer", call("st_makeenvelope", 0, 0, 3, 2), 0.5)).alias("f"),
        call("st_astext", call("st_intersection", a, call("st_makeenvelope", 4, 0, 8, 4))).alias("border"), call("st_area", call("st_envelope", a)).alias("e"),
    ).first()
    assert row["i"] == 4 and row["d"] == 12 and row["e"] == 16
    assert math.isclose(row["f"], 11.780361288064514)
    assert row["border"].startswith("LINESTRING")


def test_union_of_lists(spark):
    register(spark)
    df = spark.createDataFrame([(SQUARE,), (None,), ("POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))",)], "t string").withColumn("g", call("st_geomfromtext", "t"))
    assert df.agg(call("st_area", st_union_agg("g")).alias("a")).first()["a"] == 32
    assert df.where("false").agg(st_union_agg("g").alias("g")).first()["g"] is None


def test_geojson(spark, geo):
    assert geo("st_asgeojson", "POINT (1 2)") == '{"type":"Point","coordinates":[1.0,2.0]}'
    for text in (SQUARE, HOLED, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "LINESTRING (0 0, 1 1)", "GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (0 0, 1 1))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOINT ((1 1), (2 2))"):
        again = spark.range(1).select(call("st_astext", call("st_geomfromgeojson", call("st_asgeojson", call("st_geomfromtext", F.lit(text))))).alias("t")).first()["t"]
        assert again == spark.range(1).select(call("st_astext", call("st_geomfromtext", F.lit(text))).alias("t")).first()["t"]
    assert spark.range(1).select(call("st_geojson_simplified", call("st_geomfromtext", F.lit("POINT (1.2345678 2)")), 0.001, 5).alias("t")).first()["t"] == '{"type":"Point","coordinates":[1.23457,2.0]}'
    assert geo("st_geojson_simplified", "POLYGON EMPTY", 0.001, 5) is None


def test_broken_input_is_null(spark):
    register(spark)
    row = spark.range(1).select(call("st_area", F.lit(b"\x01\x02")).alias("a"), call("st_geomfromgeojson", F.lit("{")).alias("g"), call("st_geomfromtext", F.lit("POLYGON((")).alias("t")).first()
    assert list(row) == [None, None, None]


def test_filled_hole_counts_as_inside(spark):
    register(spark)
    filled = "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3)), ((3 3, 6 3, 6 6, 3 6, 3 3)))"
    row = spark.range(1).select(*[call("st_holds_point", call("st_geomfromtext", F.lit(t)), x, y).alias(n) for n, t, x, y in (("in", HOLED, 1, 1), ("hole", HOLED, 5, 5), ("filled", filled, 4.5, 5), ("out", HOLED, 20, 1))]).first()
    assert (row["in"], row["hole"], row["filled"], row["out"]) == (True, False, True, False)


def test_jaro_winkler(spark):
    register(spark)
    pairs = [("duck", "duckdb"), ("crate", "trace"), ("münchen", "munchen"), ("abcd", "abxy"), ("martha", "marhta"), ("ab", "ba"), ("", ""), ("a", ""), ("x", None)]
    rng = random.Random(3)
    pairs += [("".join(rng.choices("abcdé ", k=rng.randrange(9))), "".join(rng.choices("abcdé ", k=rng.randrange(9)))) for _ in range(500)]
    ours = [r["s"] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(call("jaro_winkler_similarity", "a", "b").alias("s")).collect()]
    for (a, b), s in zip(pairs, ours):
        e = duckdb.execute("SELECT jaro_winkler_similarity(?::VARCHAR, ?::VARCHAR)", [a, b]).fetchone()[0]
        assert (s is None) == (e is None) and (s is None or math.isclose(s, e, abs_tol=1e-12)), (a, b)


def test_functions_compile_wherever_the_python_package_lies(spark, monkeypatch, tmp_path):
    """Libraries come from the running JVM: a session started from another installation has nothing beside the package."""
    import pyspark

    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "elsewhere" / "__init__.py"))
    monkeypatch.delenv("SPARK_HOME", raising=False)
    assert "jts-core" in functions.class_path(spark)
    target = tmp_path / "classes"
    target.mkdir()
    functions._compile(spark, str(target))
    assert (target / "terralith" / "GeoIntersects.class").exists() or list(target.rglob("Geo*.class"))
