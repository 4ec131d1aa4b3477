"""The catalogue of 81 parameterised spatial queries, as DataFrame plans and as SQL text.

A template is data: which shape of query it is, which sources and subtypes it reads, which predicate. One builder and one SQL
writer serve all templates of a shape. Plans are lazy; anchors are one-row frames that are broadcast against one pass over the target
table, with box comparisons before any geometry function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import call, register, st_union_agg, union_of
from terralith.operators.spatial_join import spatial_join
from terralith.sources.gazetteer import BOX, with_box

DA, NE = "divisions_area", "natural_earth"
METRES_PER_DEGREE = 111320.0


@dataclass(frozen=True)
class Template:
    id: str
    family: str
    difficulty: str
    shape: str
    anchors: tuple[str, ...] = ()  # the source of each anchor
    target: str = DA  # the source that rows come from
    subtypes: tuple[str, ...] = ()  # subtypes of the rows; none: any
    options: dict = field(default_factory=dict)
    columns: tuple[str, ...] = ("id", "name", "subtype", "country")

    @property
    def parameters(self) -> tuple[str, ...]:
        """Names of the parameters that a query of this template takes."""
        names = tuple(f"anchor{i + 1}" for i in range(len(self.anchors))) if self.shape not in ("union", "near_union", "countries") else ("ids",) if self.shape != "countries" else ("countries",)
        names += {"near": ("metres",), "buffer": ("metres",), "near_union": ("metres",), "corridor": ("km",), "top": ("subtype", "n") + (("country",) if not self.anchors else ()), "rank": ("country",), "attribute": ("country",)}.get(self.shape, ())
        return names


def _t(id, family, difficulty, shape, anchors=(), target=DA, subtypes=(), columns=("id", "name", "subtype", "country"), **options) -> Template:
    return Template(id, family, difficulty, shape, tuple(anchors), target, tuple([subtypes] if isinstance(subtypes, str) else subtypes), options, columns)


_SHORT = ("id", "name", "subtype")
_SEA, _RIVER, _RELIEF = ("ocean", "sea"), ("river", "lake", "basin"), ("range/mtn", "depression")


def _catalogue() -> list[Template]:
    t = [
        _t("lookup_01", "direct_lookup", "easy", "lookup", [DA]),
        _t("lookup_02", "direct_lookup", "easy", "lookup", [NE], NE, columns=_SHORT),
        *[_t(f"disambiguate_0{i}", "disambiguation", "easy", "lookup", [DA], columns=("id", "name", "subtype", "country", "region")) for i in (1, 2, 3)],
        _t("adj_01", "adjacency", "medium", "relate", [DA], how="touches", other=True),
        _t("adj_02", "adjacency", "medium", "relate", [DA], subtypes="region", how="touches", other=True),
        _t("adj_03", "adjacency", "medium", "relate", [DA], NE, _SEA, _SHORT, how="intersects"),
        _t("adj_04", "adjacency", "medium", "relate", [DA], subtypes="county", how="touches", other=True),
        _t("adj_05", "adjacency", "medium", "relate", [DA], subtypes="country", how="touches", other=True),
        *[_t(f"adj_0{i}", "adjacency", "medium", "relate", [NE], subtypes=s, how="intersects") for i, s in ((6, "country"), (7, "region"), (8, "county"))],
        _t("adj_09", "adjacency", "medium", "relate", [DA], NE, _RIVER, _SHORT, how="intersects"),
        _t("adj_10", "adjacency", "medium", "relate", [DA], NE, "range/mtn", _SHORT, how="intersects"),
        _t("adj_11", "adjacency", "medium", "relate", [DA], NE, "plateau", _SHORT, how="intersects"),
        _t("adj_12", "adjacency", "medium", "relate", [DA], NE, ("plain", "lowland", "basin", "valley", "depression", "gorge"), _SHORT, how="intersects"),
        *[_t(f"multi_adj_0{i}", "multi_adjacency", "hard", "both", [DA, DA], subtypes=s, how="touches", other=True) for i, s in ((1, "region"), (2, "country"), (3, "county"))],
        _t("contain_01", "containment", "medium", "relate", [DA], subtypes="county", how="within", other=True),
        _t("contain_02", "containment", "medium", "relate", [DA], subtypes="country", columns=_SHORT, how="contains"),
        _t("contain_03", "containment", "medium", "relate", [DA], subtypes="region", how="within"),
        _t("contain_04", "containment", "medium", "relate", [NE], subtypes="region", how="within"),
        _t("contain_05", "containment", "medium", "relate", [NE], subtypes="country", how="intersects"),
        _t("intersect_01", "intersection", "medium-hard", "relate", [DA], subtypes="region", how="intersects", other=True),
        _t("intersect_02", "intersection", "medium-hard", "relate", [DA], subtypes="county", how="intersects", other=True),
        _t("intersect_03", "intersection", "medium-hard", "relate", [NE], subtypes="country", columns=_SHORT, how="intersects"),
        _t("intersect_04", "intersection", "medium-hard", "relate", [NE], subtypes="region", how="intersects"),
        _t("intersect_05", "intersection", "medium-hard", "relate", [DA], NE, columns=_SHORT, how="intersects"),
        _t("intersect_06", "intersection", "medium-hard", "relate", [NE], subtypes="county", how="intersects"),
        _t("buffer_01", "buffer", "hard", "near", [DA], how="intersects", other=True),
        _t("buffer_02", "buffer", "hard", "near", [NE], how="intersects"),
        _t("buffer_03", "buffer", "medium", "buffer", [DA], columns=()),
        *[_t(f"buffer_0{i}", "buffer", "hard", "near", [DA], subtypes=s, how="intersects", other=True) for i, s in ((4, "country"), (5, "region"), (6, "county"))],
        *[_t(f"buffer_{i:02d}", "buffer", "hard", "near_union", [DA] * n, subtypes=s, how="intersects", other=True) for i, n, s in ((7, 2, "region"), (8, 3, "country"), (9, 4, "region"), (10, 5, "county"))],
        _t("buffer_11", "buffer", "hard", "near", [NE], NE, columns=_SHORT, how="intersects"),
        *[
            _t(f"chained_{i:02d}", "chained", "hard", "chained", [DA], subtypes=s, how=how, other=other, meets=meets, negated=negated)
            for i, s, how, meets, negated, other in (
                (1, "county", "within", _SEA, False, False), (2, "county", "intersects", _SEA, True, False), (3, "region", "within", ("range/mtn", "island group", "peninsula", "depression"), False, False), (4, "region", "within", _RIVER, False, False), (5, "region", "within", _RELIEF, False, False),
                (6, "county", "within", _SEA, False, False), (7, "county", "within", _SEA, True, False), (8, "county", "within", _RIVER, False, False), (9, "county", "within", _RELIEF, False, False), (10, "region", "within", _SEA, False, False), (11, "region", "within", _SEA, True, False),
                (12, "country", "touches", _SEA, False, True), (13, "country", "touches", _SEA, True, True),
            )
        ],
        _t("diff_01", "difference", "hard", "overlay", [DA, DA], columns=(), op="difference"),
        _t("diff_02", "difference", "hard", "overlay", [DA, NE], columns=(), op="difference"),
        _t("corridor_01", "border_corridor", "hard", "corridor", [DA, DA], columns=()),
        _t("union_01", "set_operations", "medium-hard", "union", [DA, DA], columns=()),
        _t("union_02", "set_operations", "hard", "union_within", [DA], subtypes="county", columns=(), how="within"),
        _t("union_03", "set_operations", "medium-hard", "union", [DA, DA, DA], columns=()),
        *[_t(f"contain_multi_0{i}", "set_operations", "medium-hard", "countries", [DA] * n, subtypes=s) for i, n, s in ((1, 2, "region"), (2, 3, "region"), (3, 2, "county"))],
        *[_t(f"partial_0{i}", "partial_selection", "hard", "half", [DA], side=side) for i, side in ((1, "north"), (2, "south"), (3, "east"), (4, "west"))],
        _t("partial_05", "partial_selection", "hard", "overlay", [DA, NE], columns=(), op="intersection"),
        _t("agg_01", "aggregation", "hard", "top", [DA], how="within", largest=True),
        _t("agg_02", "aggregation", "hard", "top", [DA], how="within", largest=False),
        _t("agg_03", "aggregation", "hard", "top", largest=True),
        _t("agg_04", "aggregation", "hard", "top", largest=False),
        *[_t(f"window_0{i}", "window_function", "hard", "rank", subtypes=s, per=per, largest=big, columns=("id", "name", "subtype", "country", "region")) for i, s, per, big in ((1, "county", "region", True), (2, "county", "region", False), (3, "region", "country", True), (4, "region", "country", False))],
        _t("attr_01", "attribute_filter", "medium", "attribute", subtypes="county", flag="is_land", value=True),
        _t("attr_02", "attribute_filter", "medium", "attribute", subtypes="region", flag="is_territorial", value=True),
        _t("attr_03", "attribute_filter", "medium", "attribute", subtypes="region", flag="is_land", value=False),
        _t("attr_04", "attribute_filter", "medium", "attribute", subtypes="country", flag="is_territorial", value=True),
    ]
    return t


TEMPLATES = {t.id: t for t in _catalogue()}


def by_id(template_id: str) -> Template:
    if template_id not in TEMPLATES:
        raise ValueError(f"unknown template {template_id!r}")
    return TEMPLATES[template_id]


def by_family(family: str) -> list[Template]:
    found = [t for t in TEMPLATES.values() if t.family == family]
    if not found:
        raise ValueError(f"unknown family {family!r}")
    return found


def geojson(geometry) -> list:
    return [call("st_asgeojson", geometry).alias("geometry")]


def numbers(geometry) -> list:
    """Area and bounding box of a geometry instead of its text: what another engine can check."""
    return [F.round(call("st_area", geometry), 6).alias("area"), *[F.round(call(f"st_{c}", geometry), 6).alias(c) for c in BOX]]


class Plan:
    """Builds template queries over the two source frames."""

    def __init__(self, divisions: DataFrame, natural: DataFrame, emit=geojson):
        register(divisions.sparkSession)
        self.sources = {DA: with_box(divisions), NE: with_box(natural)}
        self.emit = emit

    def _rows(self, t: Template) -> DataFrame:
        rows = self.sources[t.target].withColumn("name", F.col("names.primary"))
        return rows.where(F.col("subtype").isin(*t.subtypes)) if t.subtypes else rows

    def _anchor(self, source: str, anchor: str, prefix: str = "a_", buffer: float | None = None) -> DataFrame:
        """The anchor's geometry and box, as a frame of one row (none if it isn't there)."""
        one = self.sources[source].where(F.col("id") == anchor).limit(1)
        geometry = F.col("geometry") if buffer is None else call("st_buffer", "geometry", buffer)
        grow = 0.0 if buffer is None else buffer
        return one.select(geometry.alias(f"{prefix}geometry"), *[(F.col(c) + (-grow if c.endswith("min") else grow)).alias(prefix + c) for c in BOX])

    @staticmethod
    def _meets(prefix: str = "a_"):
        p = prefix
        return (F.col("xmin") <= F.col(f"{p}xmax")) & (F.col(f"{p}xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col(f"{p}ymax")) & (F.col(f"{p}ymin") <= F.col("ymax"))

    def _related(self, rows: DataFrame, anchor: DataFrame, how: str, prefix: str = "a_") -> DataFrame:
        """Rows that relate to a one-row anchor: box comparison first, then the predicate."""
        return rows.join(F.broadcast(anchor), self._meets(prefix) & call(f"st_{how}", "geometry", f"{prefix}geometry"))

    def _out(self, t: Template, rows: DataFrame, geometry="geometry") -> DataFrame:
        return rows.select(*t.columns, *self.emit(geometry))

    def build(self, template_id: str, **p) -> DataFrame:
        """The query of a template with parameters anchor1, anchor2, ids, metres, km, subtype, n, country or countries, as its shape needs."""
        t = by_id(template_id)
        missing = [name for name in t.parameters if name not in p]
        if missing:
            raise ValueError(f"{template_id} needs {', '.join(missing)}")
        return getattr(self, f"_{t.shape}")(t, p)

    def _lookup(self, t, p):
        return self._out(t, self.sources[t.target].withColumn("name", F.col("names.primary")).where(F.col("id") == p["anchor1"]))

    def _relate(self, t, p, buffer=None):
        rows = self._rows(t)
        if t.options.get("other"):
            rows = rows.where(F.col("id") != p["anchor1"])
        return self._out(t, self._related(rows, self._anchor(t.anchors[0], p["anchor1"], buffer=buffer), t.options["how"]))

    def _near(self, t, p):
        return self._relate(t, p, buffer=p["metres"] / METRES_PER_DEGREE)

    def _both(self, t, p):
        rows = self._rows(t).where(~F.col("id").isin(p["anchor1"], p["anchor2"]))
        rows = self._related(rows, self._anchor(t.anchors[0], p["anchor1"]), t.options["how"])
        return self._out(t, self._related(rows, self._anchor(t.anchors[1], p["anchor2"], "b_"), t.options["how"], "b_"))

    def _buffer(self, t, p):
        one = self.sources[t.anchors[0]].where(F.col("id") == p["anchor1"])
        return one.select(call("st_buffer", "geometry", p["metres"] / METRES_PER_DEGREE).alias("g")).select(*self.emit("g"))

    def _near_union(self, t, p):
        d = p["metres"] / METRES_PER_DEGREE
        zone = self.sources[DA].where(F.col("id").isin(*p["ids"])).agg(st_union_agg(call("st_buffer", "geometry", d)).alias("a_geometry"))
        zone = zone.select("a_geometry", *[call(f"st_{c}", "a_geometry").alias(f"a_{c}") for c in BOX])
        return self._out(t, self._related(self._rows(t).where(~F.col("id").isin(*p["ids"])), zone, t.options["how"]))

    def _chained(self, t, p):
        rows = self._rows(t)
        if t.options["other"]:
            rows = rows.where(F.col("id") != p["anchor1"])
        rows = self._related(rows, self._anchor(t.anchors[0], p["anchor1"]), t.options["how"])
        rows = rows.drop("a_geometry", *[f"a_{c}" for c in BOX])
        n = self.sources[NE].where(F.col("subtype").isin(*t.options["meets"])).select("geometry", *BOX)
        return self._out(t, spatial_join(rows, n, "intersects", "left_anti" if t.options["negated"] else "left_semi"))

    def _pair(self, t, p):
        a, b = self._anchor(t.anchors[0], p["anchor1"], "a_"), self._anchor(t.anchors[1], p["anchor2"], "b_")
        return a.crossJoin(F.broadcast(b)).where(call("st_intersects", "a_geometry", "b_geometry"))  # one row each

    def _overlay(self, t, p):
        return self._pair(t, p).select(call(f"st_{t.options['op']}", "a_geometry", "b_geometry").alias("g")).select(*self.emit("g"))

    def _corridor(self, t, p):
        border = call("st_intersection", "a_geometry", "b_geometry")
        return self._pair(t, p).select(call("st_buffer", border, p["km"] * 1000.0 / METRES_PER_DEGREE).alias("g")).select(*self.emit("g"))

    def _union(self, t, p):
        # struct keeps null names, which collect_list would drop
        names = F.transform(F.array_sort(F.collect_list(F.struct(F.col("names.primary").alias("name")))), lambda s: s["name"])
        return self.sources[t.target].where(F.col("id").isin(*p["ids"])).agg(st_union_agg("geometry").alias("g"), names.alias("names")).select(*self.emit("g"), "names")

    def _union_within(self, t, p):
        rows = self._related(self._rows(t), self._anchor(t.anchors[0], p["anchor1"]), t.options["how"])
        return union_of(rows).select(*self.emit("g"))

    def _countries(self, t, p):
        return self._out(t, self._rows(t).where(F.col("country").isin(*p["countries"])))

    def _half(self, t, p):
        mid_x, mid_y = (F.col("xmin") + F.col("xmax")) / 2.0, (F.col("ymin") + F.col("ymax")) / 2.0
        box = {"north": ("xmin", mid_y, "xmax", "ymax"), "south": ("xmin", "ymin", "xmax", mid_y), "east": (mid_x, "ymin", "xmax", "ymax"), "west": ("xmin", "ymin", mid_x, "ymax")}[t.options["side"]]
        one = self.sources[t.target].withColumn("name", F.col("names.primary")).where(F.col("id") == p["anchor1"])
        return one.select(*t.columns, call("st_intersection", "geometry", call("st_makeenvelope", *box)).alias("g")).select(*t.columns, *self.emit("g"))

    def _top(self, t, p):
        rows = self.sources[t.target].withColumn("name", F.col("names.primary")).where(F.col("subtype") == p["subtype"])
        rows = self._related(rows, self._anchor(t.anchors[0], p["anchor1"]), t.options["how"]) if t.anchors else rows.where(F.col("country") == p["country"])
        size = call("st_area", "geometry")
        return self._out(t, rows.orderBy(size.desc_nulls_last() if t.options["largest"] else size.asc_nulls_last(), "id").limit(p["n"]))

    def _rank(self, t, p):
        size = call("st_area", "geometry")
        w = Window.partitionBy(t.options["per"]).orderBy(size.desc_nulls_last() if t.options["largest"] else size.asc_nulls_last(), "id")
        rows = self._rows(t).where(F.col("country") == p["country"])
        return self._out(t, rows.withColumn("_n", F.row_number().over(w)).where("_n = 1"))

    def _attribute(self, t, p):
        return self._out(t, self._rows(t).where((F.col("country") == p["country"]) & (F.col(t.options["flag"]) == t.options["value"])))


def _quote(value: str) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_quote, values)) + ")"


def sql(template_id: str, **p) -> str:
    """The same query as text, in the dialect that external writers use: double-quoted identifiers and read_parquet of a source."""
    t = by_id(template_id)
    missing = [name for name in t.parameters if name not in p]
    if missing:
        raise ValueError(f"{template_id} needs {', '.join(missing)}")
    scan = lambda source: f"read_parquet('{source}')"
    named = {"name": 'b.names."primary" AS name'}
    columns = ", ".join(named.get(c, f"b.{c}") for c in t.columns)
    head = f"SELECT {columns}{', ' if columns else ''}ST_AsGeoJSON({{}}) AS geometry"
    anchor = lambda i, g="geometry", as_="a": f"{as_} AS (SELECT {g} AS geometry FROM {scan(t.anchors[i])} WHERE id = {_quote(p[f'anchor{i + 1}'])})"
    where = []
    if t.subtypes:
        where.append(f"b.subtype = {_quote(t.subtypes[0])}" if len(t.subtypes) == 1 else f"b.subtype IN {_list(t.subtypes)}")
    excluded = [p[f"anchor{i + 1}"] for i in range(len(t.anchors)) if f"anchor{i + 1}" in p]
    if t.options.get("other") and excluded:
        where.append(f"b.id <> {_quote(excluded[0])}" if len(excluded) == 1 else f"b.id NOT IN {_list(excluded)}")
    how = {"touches": "ST_Touches", "within": "ST_Within", "contains": "ST_Contains", "intersects": "ST_Intersects"}.get(t.options.get("how", ""), "")
    target = f"{scan(t.target)} AS b"
    if t.shape == "lookup":
        return f"{head.format('b.geometry')} FROM {target} WHERE b.id = {_quote(p['anchor1'])}"
    if t.shape in ("relate", "near"):
        g = "geometry" if t.shape == "relate" else f"ST_Buffer(geometry, {p['metres']} / 111320.0)"
        return f"WITH {anchor(0, g)} {head.format('b.geometry')} FROM {target}, a WHERE {' AND '.join([*where, f'{how}(b.geometry, a.geometry)'])}"
    if t.shape == "both":
        return f"WITH {anchor(0, as_='a1')}, {anchor(1, as_='a2')} {head.format('b.geometry')} FROM {target}, a1, a2 WHERE {' AND '.join([*where, f'{how}(b.geometry, a1.geometry)', f'{how}(b.geometry, a2.geometry)'])}"
    if t.shape == "buffer":
        return f"SELECT ST_AsGeoJSON(ST_Buffer(geometry, {p['metres']} / 111320.0)) AS geometry FROM {scan(t.anchors[0])} WHERE id = {_quote(p['anchor1'])}"
    if t.shape == "near_union":
        zone = f"a AS (SELECT ST_Union_Agg(ST_Buffer(geometry, {p['metres']} / 111320.0)) AS geometry FROM {scan(DA)} WHERE id IN {_list(p['ids'])})"
        return f"WITH {zone} {head.format('b.geometry')} FROM {target}, a WHERE {' AND '.join([*where, f'b.id NOT IN {_list(p['ids'])}', f'{how}(b.geometry, a.geometry)'])}"
    if t.shape == "chained":
        inner = f"{'NOT ' if t.options['negated'] else ''}EXISTS (SELECT 1 FROM {scan(NE)} AS n WHERE n.subtype IN {_list(t.options['meets'])} AND ST_Intersects(b.geometry, n.geometry))"
        return f"WITH {anchor(0)} {head.format('b.geometry')} FROM {target}, a WHERE {' AND '.join([*where, f'{how}(b.geometry, a.geometry)', inner])}"
    if t.shape in ("overlay", "corridor"):
        g = f"ST_{t.options['op'].title()}(a.geometry, c.geometry)" if t.shape == "overlay" else f"ST_Buffer(ST_Intersection(a.geometry, c.geometry), {p['km']} * 1000.0 / 111320.0)"
        return f"WITH {anchor(0)}, {anchor(1, as_='c')} SELECT ST_AsGeoJSON({g}) AS geometry FROM a, c WHERE ST_Intersects(a.geometry, c.geometry)"
    if t.shape == "union":
        return f'SELECT ST_AsGeoJSON(ST_Union_Agg(geometry)) AS geometry, array_agg(names."primary") AS names FROM {scan(t.target)} WHERE id IN {_list(p["ids"])}'
    if t.shape == "union_within":
        return f"WITH {anchor(0)} SELECT ST_AsGeoJSON(ST_Union_Agg(b.geometry)) AS geometry FROM {target}, a WHERE {' AND '.join([*where, f'{how}(b.geometry, a.geometry)'])}"
    if t.shape == "countries":
        return f"{head.format('b.geometry')} FROM {target} WHERE {' AND '.join([*where, f'b.country IN {_list(p['countries'])}'])}"
    if t.shape == "half":
        mid_x, mid_y = "(ST_XMin(b.geometry) + ST_XMax(b.geometry)) / 2.0", "(ST_YMin(b.geometry) + ST_YMax(b.geometry)) / 2.0"
        x0, y0, x1, y1 = "ST_XMin(b.geometry)", "ST_YMin(b.geometry)", "ST_XMax(b.geometry)", "ST_YMax(b.geometry)"
        box = {"north": (x0, mid_y, x1, y1), "south": (x0, y0, x1, mid_y), "east": (mid_x, y0, x1, y1), "west": (x0, y0, mid_x, y1)}[t.options["side"]]
        return f"{head.format(f'ST_Intersection(b.geometry, ST_MakeEnvelope({', '.join(box)}))')} FROM {target} WHERE b.id = {_quote(p['anchor1'])}"
    if t.shape == "top":
        order = f"ORDER BY ST_Area(b.geometry) {'DESC' if t.options['largest'] else 'ASC'}, b.id LIMIT {int(p['n'])}"
        if t.anchors:
            return f"WITH {anchor(0)} {head.format('b.geometry')} FROM {target}, a WHERE b.subtype = {_quote(p['subtype'])} AND {how}(b.geometry, a.geometry) {order}"
        return f"{head.format('b.geometry')} FROM {target} WHERE b.subtype = {_quote(p['subtype'])} AND b.country = {_quote(p['country'])} {order}"
    if t.shape == "rank":
        ranked = f"SELECT *, row_number() OVER (PARTITION BY {t.options['per']} ORDER BY ST_Area(geometry) {'DESC' if t.options['largest'] else 'ASC'}, id) AS rn FROM {scan(t.target)} WHERE subtype = {_quote(t.subtypes[0])} AND country = {_quote(p['country'])}"
        return f"{head.format('b.geometry')} FROM ({ranked}) AS b WHERE b.rn = 1"
    if t.shape == "attribute":
        return f"{head.format('b.geometry')} FROM {target} WHERE {' AND '.join([*where, f'b.country = {_quote(p['country'])}', f'b.{t.options['flag']} = {str(t.options['value']).upper()}'])}"
    raise AssertionError(t.shape)
