"""The template catalogue and relation tables over the box gazetteer, with plain-arithmetic SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.operators import relations
from terralith.plans.templates import DA, TEMPLATES, Plan, Template, numbers
from terralith.sources import boxes

#: Parameters of the catalogue's queries: two neighbouring regions, a country, a natural feature; 2.3 degrees of distance.
_METRES = 256036.0
_DEGREES = 2.3
_ANCHORS = {
    "adj_03": ("n7",), "adj_05": ("r2",), "contain_02": ("c7",), "contain_03": ("r2",), "chained_03": ("r2",), "chained_04": ("r2",), "chained_05": ("r2",), "chained_10": ("r2",), "chained_11": ("r3",), "chained_12": ("r2",), "chained_13": ("r2",),
    "multi_adj_01": ("n2", "n12"), "multi_adj_02": ("r1", "r3"), "multi_adj_03": ("c1006", "c1023"), "contain_04": ("ne_56",), "diff_01": ("r2", "n7"), "diff_02": ("n8", "ne_11"), "corridor_01": ("n7", "n12"), "partial_05": ("n8", "ne_11"), "buffer_04": ("r2",), "intersect_01": ("n7",),
}


def parameters(t: Template) -> dict:
    anchors = _ANCHORS.get(t.id) or (("ne_11",) if t.anchors[:1] == ("natural_earth",) else ("n7",))
    p = {f"anchor{i + 1}": a for i, a in enumerate(anchors)} if t.shape not in ("union", "near_union", "countries") else {}
    if t.shape in ("union", "near_union"):
        p["ids"] = ["n7", "n12", "n17", "n22", "n2"][: len(t.anchors)] if t.subtypes != ("county",) else ["c1", "c2", "c3", "c4", "c5"][: len(t.anchors)]
    if t.shape == "countries":
        p["countries"] = [f"R{i + 1}" for i in range(len(t.anchors))]
    return p | {"metres": _METRES, "km": _METRES / 1000, "subtype": "county", "n": 5, "country": "R2"}


def template_query(template_id: str):
    def run(spark, directory: str):
        plan = Plan(boxes.divisions(spark, directory), boxes.natural(spark, directory), numbers)
        out = plan.build(template_id, **parameters(TEMPLATES[template_id]))
        return out.withColumn("names", F.array_join("names", ",")) if "names" in out.columns else out

    return run


_BOX = "round(({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0), 6) AS area, {b}.x0 AS xmin, {b}.y0 AS ymin, {b}.x1 AS xmax, {b}.y1 AS ymax"
_MEETS = "{a}.x0 <= {b}.x1 AND {b}.x0 <= {a}.x1 AND {a}.y0 <= {b}.y1 AND {b}.y0 <= {a}.y1"
_OVERLAPS = _MEETS.replace("<=", "<")


def _test(how: str, b: str, a: str) -> str:
    """Predicate of two boxes with an area: b touches, lies within, contains or intersects a."""
    within = "{b}.x0 >= {a}.x0 AND {b}.x1 <= {a}.x1 AND {b}.y0 >= {a}.y0 AND {b}.y1 <= {a}.y1"
    text = {"intersects": _MEETS, "touches": f"{_MEETS} AND NOT ({_OVERLAPS})", "within": within, "contains": within.replace("{b}", "{t}").replace("{a}", "{b}").replace("{t}", "{a}")}[how]
    return "(" + text.format(a=a, b=b) + ")"


def _near(b: str, a: str) -> str:
    return f"(pow(greatest(0, {b}.x0 - {a}.x1, {a}.x0 - {b}.x1), 2) + pow(greatest(0, {b}.y0 - {a}.y1, {a}.y0 - {b}.y1), 2) <= pow({_DEGREES}, 2))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def template_sql(template_id: str) -> str:
    t = TEMPLATES[template_id]
    p, o = parameters(t), t.options
    side = lambda s: "d" if s == DA else "n"
    columns = "".join(f"b.{c}, " for c in t.columns)
    anchors = [p.get(f"anchor{i + 1}") for i in range(len(t.anchors))]
    names = ["a", "c"]
    ctes = ", ".join([boxes.SQL, *[f"{names[i]} AS (SELECT * FROM {side(s)} WHERE id = '{anchors[i]}')" for i, s in enumerate(t.anchors[:2]) if anchors[i]]])
    where = [f"b.subtype IN {_in(t.subtypes)}"] if t.subtypes else []
    if o.get("other"):
        where.append(f"b.id NOT IN {_in(p.get('ids') or [a for a in anchors if a])}")
    start = f"WITH {ctes} SELECT {columns}{_BOX.format(b='b')} FROM {side(t.target)} AS b"

    def with_(*more: str, tables: str = ", a") -> str:
        return f"{start}{tables} WHERE {' AND '.join([*where, *more])}"

    if t.shape == "lookup":
        return f"{start} WHERE b.id = '{anchors[0]}'"
    if t.shape == "relate":
        return with_(_test(o["how"], "b", "a"))
    if t.shape == "near":
        return with_(_near("b", "a"))
    if t.shape == "both":
        return with_(_test(o["how"], "b", "a"), _test(o["how"], "b", "c"), tables=", a, c")
    if t.shape == "near_union":
        return with_(f"EXISTS (SELECT 1 FROM d AS z WHERE z.id IN {_in(p['ids'])} AND {_near('b', 'z')})", tables="")
    if t.shape == "chained":
        return with_(_test(o["how"], "b", "a"), f"{'NOT ' if o['negated'] else ''}EXISTS (SELECT 1 FROM n WHERE n.subtype IN {_in(o['meets'])} AND {_test('intersects', 'n', 'b')})")
    grown = f"round({{area}} + pow({_DEGREES}, 2) * 16 * sin(pi() / 16), 6) AS area, round({{x0}} - {_DEGREES}, 6) AS xmin, round({{y0}} - {_DEGREES}, 6) AS ymin, round({{x1}} + {_DEGREES}, 6) AS xmax, round({{y1}} + {_DEGREES}, 6) AS ymax"
    shared = {"x0": "greatest(a.x0, c.x0)", "y0": "greatest(a.y0, c.y0)", "x1": "least(a.x1, c.x1)", "y1": "least(a.y1, c.y1)"}
    if t.shape == "buffer":
        area = f"(a.x1 - a.x0) * (a.y1 - a.y0) + 2 * (a.x1 - a.x0 + a.y1 - a.y0) * {_DEGREES}"
        return f"WITH {ctes} SELECT {grown.format(area=area, x0='a.x0', y0='a.y0', x1='a.x1', y1='a.y1')} FROM a"
    if t.shape == "corridor":  # a straight border
        area = f"2 * {_DEGREES} * ({shared['x1']} - {shared['x0']} + {shared['y1']} - {shared['y0']})"
        return f"WITH {ctes} SELECT {grown.format(area=area, **shared)} FROM a, c WHERE {_test('intersects', 'a', 'c')}"
    if t.shape == "overlay":
        both = f"({shared['x1']} - {shared['x0']}) * ({shared['y1']} - {shared['y0']})"
        if o["op"] == "intersection":
            return f"WITH {ctes} SELECT round({both}, 6) AS area, {shared['x0']} AS xmin, {shared['y0']} AS ymin, {shared['x1']} AS xmax, {shared['y1']} AS ymax FROM a, c WHERE {_test('intersects', 'a', 'c')}"
        return f"WITH {ctes} SELECT round((a.x1 - a.x0) * (a.y1 - a.y0) - {both}, 6) AS area, a.x0 AS xmin, a.y0 AS ymin, a.x1 AS xmax, a.y1 AS ymax FROM a, c WHERE {_test('intersects', 'a', 'c')}"
    hull = "min(b.x0) AS xmin, min(b.y0) AS ymin, max(b.x1) AS xmax, max(b.y1) AS ymax"
    if t.shape == "union":  # regions that touch at most
        return f"WITH {ctes} SELECT round(sum((b.x1 - b.x0) * (b.y1 - b.y0)), 6) AS area, {hull}, string_agg(b.name, ',' ORDER BY b.name) AS names FROM {side(t.target)} AS b WHERE b.id IN {_in(p['ids'])}"
    if t.shape == "union_within":  # counties are unit cells, several may be the same one
        return f"WITH {ctes} SELECT round(CAST(count(DISTINCT b.x0 * 1000 + b.y0) AS DOUBLE), 6) AS area, {hull} FROM d AS b, a WHERE {' AND '.join([*where, _test(o['how'], 'b', 'a')])}"
    if t.shape == "countries":
        return with_(f"b.country IN {_in(p['countries'])}", tables="")
    if t.shape == "half":
        x, y = "(b.x0 + b.x1) / 2", "(b.y0 + b.y1) / 2"
        x0, y0, x1, y1 = {"north": ("b.x0", y, "b.x1", "b.y1"), "south": ("b.x0", "b.y0", "b.x1", y), "east": (x, "b.y0", "b.x1", "b.y1"), "west": ("b.x0", "b.y0", x, "b.y1")}[o["side"]]
        return f"WITH {ctes} SELECT {columns}round(({x1} - {x0}) * ({y1} - {y0}), 6) AS area, {x0} AS xmin, {y0} AS ymin, {x1} AS xmax, {y1} AS ymax FROM d AS b WHERE b.id = '{anchors[0]}'"
    size = f"(b.x1 - b.x0) * (b.y1 - b.y0) {'DESC' if o.get('largest') else 'ASC'}, b.id"
    if t.shape == "top":
        tests = [f"b.subtype = '{p['subtype']}'", _test(o["how"], "b", "a") if t.anchors else f"b.country = '{p['country']}'"]
        return f"{start}{', a' if t.anchors else ''} WHERE {' AND '.join(tests)} ORDER BY {size} LIMIT {p['n']}"
    if t.shape == "rank":
        return f"{start} WHERE {where[0]} AND b.country = '{p['country']}' QUALIFY row_number() OVER (PARTITION BY b.{o['per']} ORDER BY {size}) = 1"
    if t.shape == "attribute":
        return with_(f"b.country = '{p['country']}'", f"b.{o['flag']} = {str(o['value']).lower()}", tables="")
    raise AssertionError(t.shape)


def _relation(name: str, **options):
    def run(spark, directory: str):
        return relations.build(boxes.divisions(spark, directory), boxes.natural(spark, directory), name, **options)

    return run


def _pairs(a: str, b: str, s: str, t: str, columns: tuple[str, ...]) -> str:
    return ", ".join(f"{x}.{c} AS {n}_{c}" for x, n in ((a, s), (b, t)) for c in columns)


_ID3, _ID4 = ("id", "name", "subtype"), ("id", "name", "subtype", "country")
_CONTAIN = "((a.subtype = 'country' AND b.subtype IN ('region', 'county')) OR (a.subtype = 'region' AND b.subtype = 'county'))"
_SEA = f"EXISTS (SELECT 1 FROM n WHERE n.subtype IN ('sea', 'ocean') AND {_test('intersects', 'n', 'a')})"


def _containment_sql(kind: str, extra: str = "true") -> str:
    return f"WITH {boxes.SQL} SELECT {_pairs('a', 'b', 'container', 'contained', _ID3)}, a.country AS container_country, '{kind}' AS relation_type FROM d AS a JOIN d AS b ON {_CONTAIN} AND {_test('within', 'b', 'a')} WHERE {extra}"


def _adjacency_sql() -> str:
    return f"SELECT {_pairs('a', 'b', 'anchor', 'target', _ID4)}, 'adjacent' AS relation_type FROM d AS a JOIN d AS b ON a.id < b.id AND {_test('touches', 'a', 'b')}"


def _rel_intersection(spark, directory: str):
    # divisions of the fixture nest; natural features overlap
    return relations.intersection(boxes.natural(spark, directory))


def _rel_cross_limited(spark, directory: str):
    return relations.build(boxes.divisions(spark, directory), boxes.natural(spark, directory), "cross_source", limit=1800)


def _cross_sql() -> str:
    kind = f"CASE WHEN {_test('touches', 'a', 'b')} THEN 'touches' WHEN {_test('within', 'a', 'b')} THEN 'within' WHEN {_test('contains', 'a', 'b')} THEN 'contains' ELSE 'intersects' END"
    return f"SELECT {_pairs('a', 'b', 'division', 'natural', _ID3).replace('a.subtype AS division_subtype', 'a.subtype AS division_subtype, a.country AS division_country')}, {kind} AS relation_type FROM d AS a JOIN n AS b ON {_test('intersects', 'a', 'b')}"


def _common_sql() -> str:
    edge = lambda a, t: f"SELECT {', '.join(f'{a}_{c} AS a_{c}' for c in _ID3)}, {', '.join(f'{t}_{c} AS s_{c}' for c in _ID3)} FROM adj"
    return (
        f"WITH {boxes.SQL}, adj AS ({_adjacency_sql()}), e AS ({edge('anchor', 'target')} UNION ALL {edge('target', 'anchor')}) SELECT DISTINCT {', '.join(f'p.a_{c} AS anchor_{c}_1' for c in _ID3)}, {', '.join(f'q.a_{c} AS anchor_{c}_2' for c in _ID3)}, "
        f"{', '.join(f'p.s_{c} AS shared_neighbor_{c}' for c in _ID3)} FROM e AS p JOIN e AS q ON p.s_id = q.s_id AND p.a_id < q.a_id"
    )


def queries() -> dict:
    found = {f"template_{name}": template_query(name) for name in TEMPLATES}
    return found | {
        "relation_adjacency": _relation("adjacency"), "relation_containment": _relation("containment"), "relation_containment_limited": _relation("containment", limit=300), "relation_coastal_containment": _relation("coastal_containment"), "relation_landlocked_containment": _relation("landlocked_containment"),
        "relation_intersection": _rel_intersection, "relation_cross_source": _relation("cross_source"), "relation_cross_source_limited": _rel_cross_limited, "relation_common_neighbor": _relation("common_neighbor"),
    }


def oracle_sql() -> dict:
    found = {f"template_{name}": template_sql(name) for name in TEMPLATES}
    inner = f"SELECT * FROM ({_containment_sql('containment').replace(f'WITH {boxes.SQL} ', '')})"
    return found | {
        "relation_adjacency": f"WITH {boxes.SQL} {_adjacency_sql()}",
        "relation_containment": _containment_sql("containment"),
        "relation_containment_limited": f"WITH {boxes.SQL} {inner} QUALIFY row_number() OVER (PARTITION BY container_subtype, contained_subtype ORDER BY container_id, contained_id) <= 100",
        "relation_coastal_containment": _containment_sql("coastal_containment", _SEA),
        "relation_landlocked_containment": _containment_sql("landlocked_containment", f"NOT {_SEA}"),
        "relation_intersection": f"WITH {boxes.SQL} SELECT {_pairs('a', 'b', 'anchor', 'target', _ID3)}, 'intersects' AS relation_type FROM n AS a JOIN n AS b ON a.id < b.id AND ({_OVERLAPS.format(a='a', b='b')}) AND NOT {_test('within', 'a', 'b')} AND NOT {_test('within', 'b', 'a')}",
        "relation_cross_source": f"WITH {boxes.SQL} {_cross_sql()}",
        "relation_cross_source_limited": f"WITH {boxes.SQL} SELECT * FROM ({_cross_sql()}) QUALIFY row_number() OVER (PARTITION BY division_subtype, natural_subtype ORDER BY division_id, natural_id) <= 35",
        "relation_common_neighbor": _common_sql(),
    }
