"""SQL that gives the same rows as queries of this subpackage, over whole tables. What needs a tokenizer, geometry or a language model has none."""

from __future__ import annotations

# Fixed values, stated here on their own: categories of each dimension, and abbreviations in use.
CATEGORIES = {
    "task_family": "direct_lookup disambiguation attribute_filter adjacency multi_adjacency containment intersection chained buffer difference border_corridor partial_selection set_operations aggregation window_function",
    "sql_difficulty": "easy medium hard expert",
    "grounding_difficulty": "easy medium hard",
    "anchor_source": "divisions_area natural_earth mixed",
}
SHORT = {"med": "medium", "mid": "medium", "diff": "hard", "ez": "easy"}


def p1_found() -> str:
    key = lambda c: f"nullif(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
    known = ", ".join(f"('{d}', '{c.replace('_', '')}')" for d, cs in CATEGORIES.items() for c in cs.split())
    long = " UNION ALL ".join(f"SELECT id, '{d}' AS dimension, metadata.{d} AS raw FROM s" for d in CATEGORIES)
    alias = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SHORT.items()) + " ELSE k END"
    swapped = "(length(k) = length(v.key) AND list_sort(string_split(k, '')) = list_sort(string_split(v.key, '')))"
    return f"""
WITH s AS (SELECT lower(trim(id)) AS id, arg_max(metadata, loaded_at) AS metadata FROM training_samples WHERE id IS NOT NULL GROUP BY 1),
asked AS (SELECT *, {key('category')} AS key FROM sample_targets),
vocabulary AS (SELECT dimension, key FROM asked UNION SELECT * FROM (VALUES {known}) AS t(dimension, key)),
l AS (SELECT id, dimension, raw FROM ({long}) WHERE raw IS NOT NULL),
spelt AS (SELECT DISTINCT dimension, raw, {alias} AS k FROM (SELECT DISTINCT dimension, raw, {key('raw')} AS k FROM l)),
near AS (SELECT sp.dimension, sp.raw, min(struct_pack(d := levenshtein(k, v.key), r := v.key)).r AS key FROM spelt AS sp JOIN vocabulary AS v ON sp.dimension = v.dimension
         WHERE levenshtein(k, v.key) <= CASE WHEN length(v.key) >= 8 OR {swapped} THEN 2 WHEN length(v.key) >= 5 THEN 1 ELSE 0 END GROUP BY 1, 2),
have AS (SELECT l.dimension, coalesce(near.key, spelt.k) AS key, count(DISTINCT l.id) AS n FROM l JOIN spelt USING (dimension, raw) LEFT JOIN near USING (dimension, raw) GROUP BY 1, 2)
SELECT a.request_id, a.category FROM asked AS a LEFT JOIN have AS h USING (dimension, key)
WHERE coalesce(h.n, 0) < greatest(a.min_rows, ceil(round(a.target_share * floor(round(a.sample_fraction * (SELECT count(*) FROM s), 6)), 6)))
""".strip()


def p2_found() -> str:
    return """
WITH RECURSIVE s AS (SELECT lower(trim(id)) AS id, candidates, target, metadata FROM training_samples),
f AS (SELECT DISTINCT id, lower(trim(c.id)) AS feature FROM (SELECT id, target, unnest(candidates) AS c FROM s) WHERE list_contains(list_transform(target.selected_candidates, lambda x: lower(trim(x))), lower(trim(c.candidate_id))) AND trim(c.id) <> ''),
l AS (
  SELECT id, 'f:' || feature AS k FROM f
  UNION SELECT id, 'a:' || regexp_replace(lower(metadata.author), '[^a-z0-9]+', '', 'g') FROM s WHERE regexp_replace(lower(metadata.author), '[^a-z0-9]+', '', 'g') <> ''
  UNION SELECT x, 's:' || y FROM (SELECT s.id AS own, t.id AS seed FROM s JOIN s AS t ON lower(trim(s.metadata.seed_id)) = t.id AND s.id <> t.id), LATERAL (SELECT unnest([own, seed]) AS x, seed AS y)),
e AS (SELECT DISTINCT a.k AS u, b.k AS v FROM l AS a JOIN l AS b ON a.id = b.id),
r(u, v) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.v FROM r JOIN e ON r.u = e.u),
c AS (SELECT u, min(v) AS component FROM r GROUP BY 1),
m AS (SELECT DISTINCT l.id, c.component FROM l JOIN c ON l.k = c.u),
g AS (SELECT component, count(DISTINCT m.id) AS n, min(feature) AS group_key FROM m LEFT JOIN f USING (id) GROUP BY 1)
SELECT m.id AS sample_id, g.group_key FROM m JOIN g USING (component) WHERE g.n > 1
""".strip()
