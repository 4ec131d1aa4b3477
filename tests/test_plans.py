import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terralith.functions import call, register
from terralith.operators import dataset, search
from terralith.operators.ranking import hashed_rank
from terralith.operators.spatial_join import spatial_join
from terralith.plans import box_queries, export, gateway, templates
from terralith.sources import boxes, gazetteer, io


def test_catalogue_has_all_templates():
    assert len(templates.TEMPLATES) == 81 and len({t.family for t in templates.TEMPLATES.values()}) == 15
    with pytest.raises(ValueError):
        templates.by_id("nope")
    with pytest.raises(ValueError):
        templates.sql("adj_01")
    for t in templates.TEMPLATES.values():
        text = templates.sql(t.id, **box_queries.parameters(t))
        assert "ST_AsGeoJSON(" in text and "{" not in text


@pytest.fixture(scope="module")
def views(spark, data):
    d, n = boxes.divisions(spark, data).cache(), boxes.natural(spark, data).cache()
    d.createOrReplaceTempView("divisions_area")
    n.createOrReplaceTempView("natural_earth")
    return templates.Plan(d, n)


@pytest.mark.parametrize("name", ["lookup_02", "adj_04", "multi_adj_03", "contain_02", "buffer_01", "buffer_07", "chained_08", "diff_02", "corridor_01", "union_01", "union_02", "contain_multi_01", "partial_03", "partial_05", "agg_01", "agg_04", "window_03", "attr_02"])
def test_text_and_builder_agree(spark, views, name):
    p = box_queries.parameters(templates.TEMPLATES[name])
    built, text = views.build(name, **p), gateway.run(spark, templates.sql(name, **p))

    def rows(df):
        return sorted(repr(tuple(sorted(v) if isinstance(v, list) else v for v in (r[c] for c in sorted(df.columns)))) for r in df.collect())

    assert sorted(built.columns) == sorted(text.columns) and rows(built) == rows(text)


def test_gateway_refuses_and_translates():
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM read_csv('x')", "INSERT INTO t SELECT 1", ""):
        with pytest.raises(gateway.Refused):
            gateway.translate(bad)
    out = gateway.translate("```sql\nSELECT names.\"primary\", 5 / 111320.0 FROM read_parquet('/old/division_area/x') n WHERE n.subtype = 'Terrain area' ORDER BY admin_level, id DESC LIMIT 3;\n```")
    assert "`primary`" in out and "111320.0D" in out and "FROM divisions_area" in out and "IN ('range/mtn'" in out and "admin_level NULLS LAST, id DESC NULLS LAST LIMIT 3" in out
    assert gateway.translate("SELECT 'a; DROP 1.5 \"x\"' AS t") == "SELECT 'a; DROP 1.5 \"x\"' AS t"


def test_search_events_with_feedback(spark, views, data):
    d, n = views.sources["divisions_area"], views.sources["natural_earth"]
    name = d.where("subtype = 'county'").orderBy("id").first()["names"]["primary"]
    seen = []

    def writer(question, candidates, previous, error):
        seen.append(error)
        return "SELECT nonsense FROM nowhere" if error is None else templates.sql("lookup_01", anchor1=candidates[0]["id"])

    events = list(gateway.search_events(spark, f"where is {name}", d, n, places=lambda q: [name], write_sql=writer))
    assert [e["type"] for e in events] == ["places", "candidates", "sql_attempt", "sql_error", "sql_attempt", "geojson"]
    assert seen[1] and events[-1]["data"]["features"][0]["geometry"]["type"] == "Polygon"
    with pytest.raises(LookupError):
        gateway.search(spark, "x", d, n, write_sql=lambda *a: "SELECT id, geometry FROM divisions_area WHERE false", attempts=2)


def test_merge_keeps_first_place(spark):
    a = spark.createDataFrame([("d", "1", 0.5, 1), ("d", "2", 0.4, 0)], "source string, id string, similarity double, admin_level int")
    b = spark.createDataFrame([("d", "1", 0.9, 1), ("n", "1", 0.7, None)], "source string, id string, similarity double, admin_level int")
    assert [(r["source"], r["id"], r["similarity"]) for r in search.merge_candidates([a, b]).collect()] == [("n", "1", 0.7), ("d", "1", 0.5), ("d", "2", 0.4)]
    assert [search.candidates_per_source(i) for i in (1, 3, 5, 6, 9)] == [5, 3, 2, 1, 1]


def test_split_sizes(spark):
    rows = spark.range(237).selectExpr("concat('s', id) as id", "case when id % 3 = 0 then null when id % 3 = 1 then 'a' else 'b' end as stratum")
    out = dataset.stratified_split(rows, "stratum").collect()
    assert len({r["id"] for r in out}) == 237
    for s in (None, "a", "b"):
        n = [sum(r["stratum"] == s and r["split"] == k for r in out) for k in ("train", "val", "test")]
        assert n[0] == int(0.8 * sum(n)) and n[1] == int(0.1 * sum(n))
    ranks = hashed_rank(rows, ["stratum"], "x", "id").where("stratum = 'a'").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, len(ranks) + 1))


def test_validation_and_pairs(spark):
    rows = [
        ("s1", "Where?", [("c1", "f1", "Ab"), ("c2", "f2", "x,\"y")], (["c1", "c2", "c1"], "SELECT 1")), ("s2", "  ", [("c1", "f1", "Ab"), ("c2", "f1", "Ab")], (["c9"], " ")), ("s3", None, [], ([], None)), ("s4", "q", None, None),
    ]
    schema = "id string, question string, candidates array<struct<candidate_id: string, id: string, name: string>>, target struct<selected_candidates: array<string>, sql: string>"
    df = spark.createDataFrame(rows, schema).withColumn("metadata", F.lit(None).cast("string"))
    issues = {r["id"]: r["issues"] for r in dataset.validate(df).collect()}
    assert issues["s1"] == [] and len(issues["s2"]) == 3 and "no candidates" in issues["s3"] and "empty question" in issues["s3"] and "no candidates" in issues["s4"]
    full = df.withColumn("candidates", F.transform("candidates", lambda c: F.struct(c["candidate_id"].alias("candidate_id"), F.lit("n").alias("source"), c["id"].alias("id"), c["name"].alias("name"), *[F.lit(None).cast("string").alias(k) for k in ("subtype", "country", "region", "admin_level")])))
    pairs = dataset.sql_pairs(full).collect()
    assert [p["id"] for p in pairs] == ["s1"] and '"x,""y"' in pairs[0]["messages"][1]["content"]
    places = dataset.place_pairs(full).collect()
    assert len(places) == 1 and json.loads(places[0]["messages"][2]["content"])["places"] == [{"place": "Ab"}, {"place": 'x,"y'}]


def test_lengths_and_matches(spark):
    df = spark.createDataFrame([(x,) for x in [*range(1, 101), None]], "n int")
    row = dataset.length_summary(df, "n").first()
    assert (row["min"], row["max"], row["p50"], row["p90"], row["p99"], row["mean"]) == (1, 100, 51, 91, 100, 50.5)
    assert {r["upper"]: r["rows"] for r in dataset.length_histogram(df, "n", (50, 80)).collect()} == {50: 50, 80: 30, None: 20}
    none = dataset.exact_match(spark.createDataFrame([], "expected string, predicted string")).first()
    assert none["num_samples"] == 0 and none["exact_match_rate"] == 0


def test_work_items_and_rewording():
    items = dataset.work_items({"direct_lookup": 5, "difference": 2}, retries=2)
    assert len(items) == 14 and sum(t == "lookup_01" for _, t, _ in items) == 6
    assert dataset.reword("find the lakes", "x", "k1") == dataset.reword("find the lakes", "x", "k1")


def test_features(spark, tmp_path):
    register(spark)
    df = spark.createDataFrame([("a", "POINT (1 2)", None), ("b", None, 3)], "name string, t string, n int").select("name", "n", call("st_geomfromtext", "t").alias("geometry"))
    found = export.to_feature_collection(df)["features"]
    assert found[0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"name": "a"}} and found[1]["geometry"] is None and found[1]["properties"]["n"] == 3
    assert os.path.basename(export.save_geojson(df, "Where is  Ab?", str(tmp_path))) == "where_is_ab.geojson"


def test_shapefiles(spark, tmp_path):
    import struct

    ring = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]  # clockwise
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    body = struct.pack("<4d2i", 0, 0, 4, 4, 2, 10) + struct.pack("<2i", 0, 5) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    records = [(5, body), (1, struct.pack("<2d", 7, 8)), (0, b"")]
    shp = b"\0" * 100 + b"".join(struct.pack(">2i", i + 1, (len(b) + 4) // 2) + struct.pack("<i", k) + b for i, (k, b) in enumerate(records))
    fields = [("NAME", 10), ("ne_id", 6), ("featurecla", 10)]
    header = struct.pack("<B3BIHH20x", 3, 1, 1, 1, 3, 32 + 32 * len(fields) + 1, 1 + sum(n for _, n in fields)) + b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([n]) + b"\0" * 15 for name, n in fields) + b"\r"
    dbf = header + b"".join(b" " + "".join(v.ljust(n) for v, (_, n) in zip(r, fields)).encode() for r in (("Ab", "12", "Lake"), ("nan", "", "Point"), ("", "", "")))
    (tmp_path / "ne_lakes.shp").write_bytes(shp)
    (tmp_path / "ne_lakes.dbf").write_bytes(dbf)
    rows = io.read_shapefiles(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and rows[0]["id"] == "ne_12" and rows[0]["names"]["primary"] == "Ab" and rows[0]["subtype"] == "lake" and rows[0]["is_land"] is True
    register(spark)
    area = spark.createDataFrame([(rows[0]["geometry"],)], "g binary").select(call("st_area", "g").alias("a")).first()["a"]
    assert area == 15 and rows[1]["names"]["primary"] is None and rows[2]["geometry"] is None


def test_streaming_adjacency_equals_batch(spark, data, tmp_path):
    from terralith.operators import relations
    from terralith.streaming import incremental

    d = boxes.divisions(spark, data).where("subtype <> 'county'")
    d.where("subtype = 'country'").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    schema = d.schema
    src = str(tmp_path / "in" / "*")
    incremental.start(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination(120)
    d.where("subtype = 'region'").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    incremental.start(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination(120)
    got = {(r["anchor_id"], r["target_id"]) for r in spark.read.parquet(str(tmp_path / "out" / "adjacency")).collect()}
    assert got == {(r["anchor_id"], r["target_id"]) for r in relations.adjacency(d).collect()} and got


def test_samples_are_generated_for_every_family(spark, data):
    from terralith.operators import relations
    from terralith.operators.drawing import Draw

    d, n = boxes.divisions(spark, data).cache(), boxes.natural(spark, data).cache()
    d.createOrReplaceTempView("divisions_area")
    n.createOrReplaceTempView("natural_earth")
    made = {"containment": relations.containment(d), "adjacency": relations.adjacency(d).cache(), "cross_source": relations.cross_source(d, n)}
    draw = Draw(d, n, made | {"common_neighbor": relations.common_neighbor(made["adjacency"])})
    drawn = {name: draw(t, "sample_000001") for name, t in templates.TEMPLATES.items()}
    assert [name for name, x in drawn.items() if x is None and not {"ocean", "sea", "country"} & set(templates.TEMPLATES[name].subtypes)] == []
    assert draw(templates.TEMPLATES["adj_04"], "sample_000001") == drawn["adj_04"]
    out, outcome = dataset.generate(spark, d, n, [("direct_lookup", "lookup_01", "sample_000001"), ("containment", "contain_01", "sample_000002"), ("partial_selection", "partial_05", "sample_000003")], draw)
    assert [s["id"] for s in out] == ["sample_000001", "sample_000002", "sample_000003"] and out[2]["metadata"]["anchor_source"] == "mixed"
    assert outcome == {"tried": 3, "undrawn": 0, "failed": 0, "empty": 0, "made": 3, "rate": 1.0}
    checked = dataset.validate(spark.createDataFrame(out, io.SAMPLE)).collect()
    assert all(r["issues"] == [] and r["target"]["selected_candidates"] for r in checked)


def test_every_row_can_be_drawn(spark):
    from terralith.operators.drawing import Draw

    place = "struct<primary: string>"
    d = spark.range(300).selectExpr("concat('d', id) id", f"cast(named_struct('primary', concat('D', id)) as {place}) names", "'county' subtype", "concat('C', id % 150) country", "'x' geometry")
    pairs = spark.range(300).selectExpr("concat('d', id) anchor_id", "concat('D', id) anchor_name", "'county' anchor_subtype", "concat('d', id + 1) target_id", "concat('D', id + 1) target_name", "if(id < 298, 'county', 'region') target_subtype")
    draw = Draw(d, d.where("false"), {"adjacency": pairs})
    items = [(name, t, f"sample_{i:06d}") for name, t in (("adjacency", "adj_04"), ("adjacency", "adj_02"), ("direct_lookup", "lookup_01")) for i in range(3000)]
    if hasattr(draw, "prepare"):
        draw.prepare(items)
    drawn = {}
    for _, t, sample_id in items:
        drawn.setdefault(t, set()).add(draw(templates.TEMPLATES[t], sample_id)[2][0])
    assert drawn["adj_04"] == {("divisions_area", f"d{i}", f"D{i}") for i in range(298)} and {a[1] for a in drawn["adj_02"]} == {"d298", "d299"}
    assert {a[1] for a in drawn["lookup_01"]} == {f"d{i}" for i in range(300)}
    assert len({draw(templates.TEMPLATES["attr_01"], f"sample_{i:06d}")[1]["country"] for i in range(30)}) > 20


def test_anchors_come_from_the_relation_of_the_question(spark):
    from terralith.operators.drawing import Draw

    place = "struct<primary: string>"
    d = spark.range(20).selectExpr("concat('d', id) id", f"cast(named_struct('primary', concat('D', id)) as {place}) names", "'county' subtype", "'C' country", "'x' geometry")
    pair = lambda a, b, x: spark.range(1).selectExpr(f"'{x}1' {a}_id", f"'{x}' {a}_name", f"'region' {a}_subtype", f"'{x}2' {b}_id", f"'{x}' {b}_name", f"'county' {b}_subtype")
    made = {"containment": pair("container", "contained", "plain"), "coastal_containment": pair("container", "contained", "coast"), "landlocked_containment": pair("container", "contained", "inland"), "intersection": pair("anchor", "target", "across")}
    draw = Draw(d, d.where("false"), made)
    got = {name: [a[1] for a in draw(templates.TEMPLATES[name], "sample_000001")[2]] for name in ("chained_01", "chained_06", "chained_02", "chained_07", "chained_08", "intersect_02", "diff_01")}
    assert got == {"chained_01": ["coast1"], "chained_06": ["coast1"], "chained_02": ["inland1"], "chained_07": ["inland1"], "chained_08": ["plain1"], "intersect_02": ["across1"], "diff_01": ["across1", "across2"]}
    assert draw(templates.TEMPLATES["contain_01"], "sample_000001")[2][0][1] == "plain1"


def test_comment_marks_in_literals_stay():
    text = gateway.translate("SELECT id FROM read_parquet('divisions_area') -- all\nWHERE names.\"primary\" = 'Foo--Bar' AND country = 'a/*x*/b' /* done */")
    assert "'Foo--Bar'" in text and "'a/*x*/b'" in text and "all" not in text and "done" not in text


def test_exists_goes_through_the_grid(spark, data):
    d, n = boxes.divisions(spark, data), boxes.natural(spark, data)
    d.createOrReplaceTempView("divisions_area")
    n.createOrReplaceTempView("natural_earth")
    for no, how in (("", "left_semi"), ("NOT ", "left_anti")):
        text = f"SELECT b.id FROM read_parquet('divisions_area') AS b WHERE b.subtype = 'county' AND {no}EXISTS (SELECT 1 FROM read_parquet('natural_earth') AS n WHERE n.subtype IN ('river', 'lake') AND ST_Intersects(n.geometry, b.geometry))"
        df = gateway.run(spark, text)
        assert "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().optimizedPlan().toString() and "_met" in df._jdf.queryExecution().analyzed().toString()
        expected = spatial_join(d.where("subtype = 'county'"), n.where("subtype in ('river', 'lake')"), "intersects", how)
        assert {r["id"] for r in df.collect()} == {r["id"] for r in expected.collect()}
    same = gateway._through_grid(spark, "SELECT 1 FROM divisions_area b WHERE EXISTS (SELECT 1 FROM natural_earth n WHERE n.country = b.country AND ST_Intersects(b.geometry, n.geometry))")
    assert "natural_earth n" in same


def test_writers_that_start_are_announced(spark, data):
    d, n = boxes.divisions(spark, data), boxes.natural(spark, data)
    events = list(gateway.search_events(spark, "Show Nowhere", d.where("false"), n.where("false"), ready=lambda: False))
    assert [e["type"] for e in events] == ["warming_up", "places", "error"]


def test_large_collections_are_refused(spark):
    df = spark.range(5).selectExpr("id", "cast(null as binary) geometry")
    assert len(export.to_feature_collection(df, 5)["features"]) == 5
    with pytest.raises(ValueError):
        export.to_feature_collection(df, 4)


def test_statements_and_conversations(spark):
    pretty = dataset.pretty_sql("select a, 'x  from y' as b from t where a = 1 and b = \"order by\"  order by a limit 3")
    assert pretty == "SELECT a, 'x  from y' AS b\nFROM t\nWHERE a = 1\n    AND b = \"order by\"\nORDER BY a\nLIMIT 3"
    said = [[("user", "<A>x</A> <USER_QUERY>\n where is it? \n</USER_QUERY>"), ("assistant", "s")], [("user", "plain"), ("assistant", "s")]]
    rows = spark.createDataFrame([(m,) for m in said], "messages array<struct<role: string, content: string>>").select(dataset.user_query(F.col("messages")).alias("q")).collect()
    assert [r["q"] for r in rows] == ["where is it?", "plain"]
    results = spark.createDataFrame([(1, "sql", "test", "a", "a"), (2, "places", "test", "a", "b"), (3, "sql", "val", "a", "a")], "id int, task string, split string, expected string, predicted string")
    assert [r["id"] for r in dataset.evaluated(results, "sql", "test").collect()] == [1] and dataset.evaluated(results, ids=["2", "3"]).count() == 2 and dataset.evaluated(results, label="x").count() == 0
    candidates = spark.createDataFrame([(1, "a", "country", "XA"), (2, "b", "country", "XA"), (3, "c", "region", "XA"), (4, "c", "region", "XA"), (5, "d", "country", None)], "position int, id string, subtype string, country string")
    assert sorted((r["candidate_id"], r["id"]) for r in dataset.one_per_country(candidates).collect()) == [("c1", "a"), ("c2", "c"), ("c3", "d")]
    over = {r["upper"]: (r["over"], r["percent"]) for r in dataset.length_exceedance(spark.createDataFrame([(10,), (2000,), (5000,), (None,)], "n int"), "n").collect()}
    assert over == {1024: (2, 66.666667), 2048: (1, 33.333333), 4096: (1, 33.333333)} and dataset.length_exceedance(spark.createDataFrame([], "n int"), "n").where("over > 0").count() == 0


def test_rewordings_carry_names_over():
    found = {dataset.reword("Which counties touch Lake Quell?", "adjacency", f"k{i}")[0] for i in range(60)}
    assert len(found) > 3 and all("Lake Quell" in q for q in found)


def test_files_on_any_store(spark, tmp_path):
    from terralith.session import exists, read_text

    path = f"file://{tmp_path}/x/stats.json"
    assert not exists(spark, path)
    io.save_stats(spark, {"a": "é"}, path)
    assert exists(spark, path) and '"é"' in read_text(spark, path)
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception):
        io.read_samples(spark, str(tmp_path / "bad.jsonl")).select("question", "id").collect()
    assert io.skipped_layer("ne_10m_graticules_1") and io.skipped_layer("ne_10m_land_ocean_seams") and not io.skipped_layer("ne_10m_lakes")


def test_normalised_copy_is_preferred(spark, data, tmp_path):
    gazetteer.normalize(spark, data, str(tmp_path))
    got = gazetteer.read(spark, str(tmp_path), "divisions_area")
    assert {"xmin", "ymax"} <= set(got.columns) and got.where("geometry is null or not is_land").count() == 0


@pytest.mark.parametrize("name", ["fuzzy_two_sources", "merged", "template_adj_04", "template_window_01", "relation_cross_source", "dataset_split", "candidate_lookup"])
def test_registered_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{data}/{f}'")
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = sorted((tuple(tidy(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(tidy(v) for v in r) for r in con.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
