"""Queries over the place, sample and star-schema tables: search, sampling, statistics, splits, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.functions import call, register
from terralith.operators import dataset, search
from terralith.operators.ranking import sample_rows
from terralith.plans import export, gateway
from terralith.plans.templates import sql as template_sql
from terralith.session import table
from terralith.sources import boxes, gazetteer

PLACE, OTHER = "Noxzaixkuth", "Lake Zeilvaiwam"


def _sources(spark, d):
    return table(spark, d, "divisions_area"), table(spark, d, "natural_earth")


def _shown(df):
    return df.select("source", "id", "name", "subtype", "country", "region", "admin_level", F.round("similarity", 9).alias("similarity"))


def fuzzy_divisions(spark, d):
    return _shown(search.fuzzy_search(_sources(spark, d)[0], "divisions_area", PLACE, 5))


def fuzzy_natural(spark, d):
    return _shown(search.fuzzy_search(_sources(spark, d)[1], "natural_earth", OTHER, 5))


def fuzzy_two_sources(spark, d):
    return _shown(search.search_candidates(*_sources(spark, d), PLACE, 4))


def merged(spark, d):
    a, n = _sources(spark, d)
    return _shown(search.merge_candidates([search.search_candidates(a, n, p, 4) for p in (PLACE, OTHER)]))


def distractor_rank(spark, d):
    return _shown(search.distractors(*_sources(spark, d), PLACE, "divisions_area", "none", 6))


def interleaved(spark, d):
    from pyspark.sql import Window

    one = Window.partitionBy("_one").orderBy("id")  # ten rows each
    lists = [df.select(F.lit(s).alias("source"), "id").distinct().orderBy("id").limit(10).withColumn("_one", F.lit(1)).withColumn("position", F.row_number().over(one)).drop("_one") for df, s in zip(_sources(spark, d), ("divisions_area", "natural_earth"))]
    return search.interleave(lists, 7).select("candidate_id", "source", "id", F.col("rank").cast("long").alias("rank"))


def similarity_scores(spark, d):
    register(spark)
    names = table(spark, d, "canonical_places")
    return names.select("canonical_id", F.round(call("jaro_winkler_similarity", F.lower("name"), F.lit("kalküzmet bay")), 9).alias("similarity"))


def inventory_divisions(spark, d):
    return gazetteer.inventory(boxes.divisions(spark, d), "divisions_area").select("source", "id", "name", "subtype", "country", "region", "admin_level", "is_land", "is_territorial", F.round("area_sq_deg", 6).alias("area_sq_deg"), "xmin", "ymin", "xmax", "ymax")


def inventory_natural(spark, d):
    return gazetteer.inventory(boxes.natural(spark, d), "natural_earth").select("source", "id", "name", "subtype", "is_land", F.round("area_sq_deg", 6).alias("area_sq_deg"), "xmin", "ymin", "xmax", "ymax")


def inventory_counts(spark, d):
    return gazetteer.inventory(table(spark, d, "divisions_area"), "divisions_area").groupBy("subtype", "country").agg(F.count("*").alias("features"), F.countDistinct("id").alias("ids"))


def normalized_divisions(spark, d):
    return gazetteer.normalize_divisions(table(spark, d, "divisions_area")).groupBy("subtype", "country", "is_land").agg(F.count("*").alias("rows"))


def normalized_natural(spark, d):
    return gazetteer.normalize_natural(table(spark, d, "natural_earth")).groupBy("subtype", "source_layer").agg(F.count("*").alias("rows"))


def sampled_anchors(spark, d):
    return sample_rows(table(spark, d, "divisions_area").where("subtype = 'county'").select("id", F.col("names.primary").alias("name"), "country").distinct(), 20, "42")


def distinct_countries(spark, d):
    return table(spark, d, "divisions_area").where("country is not null").select("country").distinct()


def dataset_validation(spark, d):
    return dataset.validate(table(spark, d, "training_samples")).groupBy(F.array_join("issues", "; ").alias("issues")).agg(F.count("*").alias("samples"))


def dataset_statistics(spark, d):
    return dataset.statistics(table(spark, d, "training_samples"))


def dataset_coverage(spark, d):
    return dataset.coverage(table(spark, d, "training_samples"))


def dataset_split(spark, d):
    rows = table(spark, d, "training_samples").groupBy("id").agg(F.min(F.coalesce("metadata.template_id", "metadata.task_family")).alias("stratum"))
    return dataset.stratified_split(rows, "stratum").select("id", "stratum", "split")


def dataset_sql_pairs(spark, d):
    pairs = dataset.sql_pairs(table(spark, d, "training_samples"))
    return pairs.select("id", F.size("messages").alias("messages"), F.col("messages")[2]["content"].alias("answer"), F.length(F.col("messages")[1]["content"]).alias("user_length"))


def dataset_place_pairs(spark, d):
    return dataset.place_pairs(table(spark, d, "training_samples")).select("id", F.get_json_object(F.col("messages")[2]["content"], "$.places[0].place").alias("first_place"), F.size(F.from_json(F.col("messages")[2]["content"], "places array<struct<place: string>>")["places"]).alias("places"))


def evaluation(spark, d):
    rows = table(spark, d, "training_samples").select(F.col("target.sql").alias("expected"), F.when(F.col("metadata.sql_verified"), F.concat(F.lit("  "), F.col("target.sql"))).alias("predicted"))
    return dataset.exact_match(rows)


def length_percentiles(spark, d):
    return dataset.length_summary(table(spark, d, "documents").select(F.length("text").cast("long").alias("n")), "n")


def length_buckets(spark, d):
    return dataset.length_histogram(table(spark, d, "documents").select(F.length("text").cast("long").alias("n")), "n")


def source_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


def event_properties(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").alias("total"))


def candidate_lookup(spark, d):
    """Selected candidates of every sample, by key lookup."""
    s = table(spark, d, "training_samples").select("id", F.explode("target.selected_candidates").alias("candidate_id"), "candidates")
    picked = s.select("id", "candidate_id", F.get(F.filter("candidates", lambda c: c["candidate_id"] == F.col("candidate_id")), F.lit(0)).alias("c"))
    return picked.where("c is not null").groupBy(F.col("c.source").alias("source"), F.col("c.subtype").alias("subtype")).agg(F.count("*").alias("selected"))


def _emitted(rows):
    """Rows of a statement with its GeoJSON read back."""
    g = call("st_geomfromgeojson", "geometry")
    return rows.select("id", "name", "subtype", "country", F.round(call("st_area", g), 6).alias("area"), call("st_xmin", g).alias("xmin"), call("st_ymax", g).alias("ymax"))


def length_over(spark, d):
    """Texts longer than each limit."""
    return dataset.length_exceedance(table(spark, d, "documents").select(F.length("text").alias("n")), "n").select("upper", F.col("over").alias("rows"), "percent")


def country_candidates(spark, d):
    """Candidates of which those that are countries stand once for each code."""
    a = boxes.divisions(spark, d).where(F.col("subtype").isin("country", "region"))
    rows = a.select("id", "subtype", "country").withColumn("position", F.col("id"))
    return dataset.one_per_country(rows).select("candidate_id", "id", "subtype", "country")


def gateway_sql(spark, d):
    """A template's text, in the foreign dialect, through the gateway."""
    boxes.divisions(spark, d).createOrReplaceTempView("divisions_area")
    boxes.natural(spark, d).createOrReplaceTempView("natural_earth")
    return _emitted(gateway.run(spark, template_sql("chained_08", anchor1="n7")))


def gateway_top(spark, d):
    boxes.divisions(spark, d).createOrReplaceTempView("divisions_area")
    boxes.natural(spark, d).createOrReplaceTempView("natural_earth")
    return _emitted(gateway.run(spark, template_sql("agg_03", subtype="region", n=7, country="R2")))


def feature_export(spark, d):
    """Features of all natural boxes as GeoJSON, read back."""
    rows = export.feature_rows(boxes.natural(spark, d).select("id", "subtype", "country", "geometry"))
    register(spark)
    parsed = rows.select(F.get_json_object("feature", "$.properties.id").alias("id"), call("st_geomfromgeojson", F.get_json_object("feature", "$.geometry")).alias("g"), F.get_json_object("feature", "$.properties.country").alias("country"))
    return parsed.select("id", "country", F.round(call("st_area", "g"), 6).alias("area"), call("st_xmin", "g").alias("xmin"), call("st_ymax", "g").alias("ymax"))


def collection_bounds(spark, d):
    out = export.collection_box(boxes.natural(spark, d))
    return out.select("xmin", "ymin", "xmax", "ymax", F.round("zoom", 6).alias("zoom"))


def simplified_geojson(spark, d):
    """Simplified, rounded GeoJSON of all divisions: how many there are and whether they parse."""
    register(spark)
    rows = table(spark, d, "divisions_area").select("subtype", call("st_geojson_simplified", "geometry", 0.001, 5).alias("j"))
    return rows.groupBy("subtype").agg(F.count("*").alias("rows"), F.count(call("st_geomfromgeojson", "j")).alias("parsed"))


NAMES = ("fuzzy_divisions fuzzy_natural fuzzy_two_sources merged distractor_rank interleaved similarity_scores inventory_divisions inventory_natural inventory_counts normalized_divisions normalized_natural sampled_anchors distinct_countries dataset_validation dataset_statistics dataset_coverage dataset_split "
         "dataset_sql_pairs dataset_place_pairs evaluation length_percentiles length_buckets source_counts length_over country_candidates event_properties candidate_lookup gateway_sql gateway_top feature_export collection_bounds simplified_geojson").split()  # fmt: skip


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def _fuzzy_sql(source: str, place: str, k: int, extra: str = "", name: str | None = None) -> str:
    name = name or ("names.common['en']" if source == "divisions_area" else "names.\"primary\"")
    # the source is materialised first: filters on nested fields are then not pushed into its scan
    return (
        f"WITH src AS MATERIALIZED (SELECT id, names, subtype, country, region, admin_level FROM {source}) SELECT '{source}' AS source, id, {name} AS name, subtype, country, region, admin_level, round(jaro_winkler_similarity(lower({name}), lower('{place}')), 9) AS similarity, jaro_winkler_similarity(lower({name}), lower('{place}')) AS s FROM src "
        f"WHERE trim({name}) != '' {extra} ORDER BY s DESC, admin_level ASC NULLS LAST, id LIMIT {k}"
    )


_OUT = "source, id, name, subtype, country, region, admin_level, similarity"


def _both(place: str, k: int) -> str:
    return f"SELECT * FROM ({_fuzzy_sql('divisions_area', place, k)}) UNION ALL SELECT * FROM ({_fuzzy_sql('natural_earth', place, k)})"


def oracle_sql() -> dict:
    md5 = "md5('42' || id)"
    once = "(SELECT * FROM src WHERE trim(names.\"primary\") != '' AND id <> 'none' QUALIFY row_number() OVER (PARTITION BY id ORDER BY names.\"primary\") = 1)"
    near = lambda s, k: _fuzzy_sql(s, PLACE, k, name='names."primary"').replace("FROM src ", f"FROM {once} ")
    first = lambda s: f"SELECT '{s}' AS source, id, row_number() OVER (ORDER BY id) AS position FROM (SELECT DISTINCT id FROM {s} ORDER BY id LIMIT 10)"
    area = "round((x1 - x0) * (y1 - y0), 6) AS area_sq_deg, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax"
    stat = lambda dim, value: f"SELECT '{dim}' AS dimension, {value} AS value, count(*) AS samples, round(avg(len(candidates)), 6) AS avg_candidates, round(avg(w), 6) AS avg_words FROM s GROUP BY ALL"
    words = r"len(list_filter(regexp_split_to_array(trim(question), '\s+'), lambda x: x <> ''))"
    chosen = "SELECT unnest(list_filter(candidates, lambda c: list_contains(target.selected_candidates, c.candidate_id))) AS c FROM training_samples"
    picked = "list_filter(list_transform(target.selected_candidates, lambda x: trim(list_filter(candidates, lambda c: c.candidate_id = x)[1].name)), lambda n: n <> '')"
    template = boxes.SQL
    return {
        "fuzzy_divisions": f"SELECT {_OUT} FROM ({_fuzzy_sql('divisions_area', PLACE, 5)})",
        "fuzzy_natural": f"SELECT {_OUT} FROM ({_fuzzy_sql('natural_earth', OTHER, 5)})",
        "fuzzy_two_sources": f"SELECT {_OUT} FROM ({_both(PLACE, 4)})",
        "merged": f"SELECT {_OUT} FROM (SELECT *, 0 AS l FROM ({_both(PLACE, 4)}) UNION ALL SELECT *, 1 FROM ({_both(OTHER, 4)})) QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY l, s DESC) = 1",
        "distractor_rank": f"SELECT {_OUT} FROM (SELECT * FROM ({near('divisions_area', 3)}) UNION ALL SELECT * FROM ({near('natural_earth', 3)}))",
        "interleaved": f"SELECT 'c' || rank AS candidate_id, source, id, rank FROM (SELECT *, row_number() OVER (ORDER BY position, source) AS rank FROM ({first('divisions_area')} UNION ALL {first('natural_earth')})) WHERE rank <= 7",
        "similarity_scores": "SELECT canonical_id, round(jaro_winkler_similarity(lower(name), 'kalküzmet bay'), 9) AS similarity FROM canonical_places",
        "inventory_divisions": f"WITH {template} SELECT 'divisions_area' AS source, id, name, subtype, country, region, admin_level, is_land, is_territorial, {area} FROM d",
        "inventory_natural": f"WITH {template} SELECT 'natural_earth' AS source, id, name, subtype, is_land, {area} FROM n",
        "inventory_counts": "SELECT subtype, country, count(*) AS features, count(DISTINCT id) AS ids FROM divisions_area WHERE geometry IS NOT NULL AND trim(names.\"primary\") != '' GROUP BY 1, 2",
        "normalized_divisions": "SELECT lower(trim(subtype)) AS subtype, country, is_land, count(*) AS rows FROM divisions_area WHERE geometry IS NOT NULL AND lower(trim(subtype)) IN ('country', 'region', 'county') AND is_land GROUP BY 1, 2, 3",
        "normalized_natural": "SELECT lower(trim(subtype)) AS subtype, source_layer, count(*) AS rows FROM natural_earth WHERE geometry IS NOT NULL GROUP BY 1, 2",
        "sampled_anchors": f"SELECT id, name, country FROM (SELECT DISTINCT id, names.\"primary\" AS name, country FROM divisions_area WHERE subtype = 'county') ORDER BY {md5}, id LIMIT 20",
        "distinct_countries": "SELECT DISTINCT country FROM divisions_area WHERE country IS NOT NULL",
        "dataset_validation": (
            "SELECT concat_ws('; ', CASE WHEN coalesce(len(candidates), 0) = 0 THEN 'no candidates' END, CASE WHEN len(list_filter(target.selected_candidates, lambda x: NOT list_contains(list_transform(candidates, lambda c: c.candidate_id), x))) > 0 THEN 'selected candidate not in list' END, "
            "CASE WHEN len(list_distinct(list_transform(candidates, lambda c: c.id))) < len(candidates) THEN 'duplicate candidates' END, CASE WHEN coalesce(trim(question), '') = '' THEN 'empty question' END) AS issues, count(*) AS samples FROM training_samples GROUP BY 1"
        ),
        "dataset_statistics": f"WITH s AS (SELECT *, {words} AS w FROM training_samples) " + " UNION ALL ".join([*[stat(f, f"metadata.{f}") for f in ("task_family", "sql_difficulty", "grounding_difficulty", "anchor_source")], stat("all", "CAST(NULL AS VARCHAR)")]),
        "dataset_coverage": f"SELECT DISTINCT kind, value FROM (SELECT 'country' AS kind, c.country AS value FROM ({chosen}) UNION ALL SELECT 'subtype', c.subtype FROM ({chosen})) WHERE value <> ''",
        "dataset_split": (
            "WITH s AS (SELECT id, min(coalesce(metadata.template_id, metadata.task_family)) AS stratum FROM training_samples GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42' || id), id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s) "
            "SELECT id, stratum, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM r"
        ),
        "evaluation": "SELECT count(*) AS num_samples, count(*) FILTER (metadata.sql_verified AND target.sql IS NOT NULL) AS exact_matches, coalesce(avg(CASE WHEN metadata.sql_verified AND target.sql IS NOT NULL THEN 1.0 ELSE 0.0 END), 0) AS exact_match_rate FROM training_samples",
        "dataset_place_pairs": f"SELECT id, p[1] AS first_place, CAST(len(list_distinct(list_transform(p, lambda n: lower(n)))) AS INTEGER) AS places FROM (SELECT id, {picked} AS p FROM training_samples) WHERE len(p) > 0",
        "length_percentiles": "WITH l AS (SELECT length(text) AS v FROM documents WHERE text IS NOT NULL), s AS (SELECT list_sort(list(v)) AS x FROM l) SELECT x[1] AS min, x[len(x)] AS max, round((SELECT avg(v) FROM l), 6) AS mean, x[CAST(floor(len(x) * 0.5) AS BIGINT) + 1] AS p50, x[CAST(floor(len(x) * 0.9) AS BIGINT) + 1] AS p90, x[CAST(floor(len(x) * 0.95) AS BIGINT) + 1] AS p95, x[CAST(floor(len(x) * 0.99) AS BIGINT) + 1] AS p99 FROM s",
        "length_buckets": "WITH l AS (SELECT length(text) AS v FROM documents WHERE text IS NOT NULL) SELECT CAST(CASE WHEN v <= 512 THEN 512 WHEN v <= 1024 THEN 1024 WHEN v <= 2048 THEN 2048 WHEN v <= 4096 THEN 4096 WHEN v <= 8192 THEN 8192 END AS INTEGER) AS upper, count(*) AS rows, round(100.0 * count(*) / (SELECT count(*) FROM l), 6) AS percent FROM l GROUP BY 1",
        "source_counts": "SELECT source, lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY 1, 2",
        "event_properties": "SELECT event_type, count(*) AS events, min(k) AS least, max(k) AS most, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
        "candidate_lookup": "SELECT c.source AS source, c.subtype AS subtype, count(*) AS selected FROM (SELECT list_filter(candidates, lambda c: c.candidate_id = x)[1] AS c FROM (SELECT candidates, unnest(target.selected_candidates) AS x FROM training_samples)) WHERE c IS NOT NULL GROUP BY 1, 2",
        "gateway_sql": f"WITH {template}, a AS (SELECT * FROM d WHERE id = 'n7') SELECT b.id, b.name, b.subtype, b.country, round((b.x1 - b.x0) * (b.y1 - b.y0), 6) AS area, b.x0 AS xmin, b.y1 AS ymax FROM d AS b, a WHERE b.subtype = 'county' AND b.x0 >= a.x0 AND b.x1 <= a.x1 AND b.y0 >= a.y0 AND b.y1 <= a.y1 AND EXISTS (SELECT 1 FROM n WHERE n.subtype IN ('river', 'lake', 'basin') AND n.x0 <= b.x1 AND b.x0 <= n.x1 AND n.y0 <= b.y1 AND b.y0 <= n.y1)",
        "length_over": "WITH l AS (SELECT length(text) AS v FROM documents WHERE text IS NOT NULL), t AS (SELECT CAST(unnest([1024, 2048, 4096]) AS INTEGER) AS upper) SELECT upper, count(*) FILTER (v > upper) AS rows, round(100.0 * count(*) FILTER (v > upper) / count(*), 6) AS percent FROM t, l GROUP BY upper",
        "country_candidates": f"WITH {template}, k AS (SELECT id, subtype, country, row_number() OVER (PARTITION BY CASE WHEN subtype = 'country' THEN 'c:' || country ELSE 'i:' || id END ORDER BY id) AS r FROM d WHERE subtype IN ('country', 'region')) SELECT 'c' || row_number() OVER (ORDER BY id) AS candidate_id, id, subtype, country FROM k WHERE r = 1",
        "gateway_top": f"WITH {template} SELECT id, name, subtype, country, round((x1 - x0) * (y1 - y0), 6) AS area, x0 AS xmin, y1 AS ymax FROM d WHERE subtype = 'region' AND country = 'R2' ORDER BY (x1 - x0) * (y1 - y0) DESC, id LIMIT 7",
        "feature_export": f"WITH {template} SELECT id, country, round((x1 - x0) * (y1 - y0), 6) AS area, x0 AS xmin, y1 AS ymax FROM n",
        "collection_bounds": f"WITH {template} SELECT min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax, round(greatest(0, least(18, log2(360 / greatest(max(x1) - min(x0), max(y1) - min(y0))) - 0.8)), 6) AS zoom FROM n",
    }
