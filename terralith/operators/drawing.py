"""Drawing parameters for query templates from inventories and relation tables, the same ones for the same sample id."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.ranking import hashed_rank
from terralith.operators.relations import SEA
from terralith.plans.templates import DA, NE, TEMPLATES, Template

#: A kind of rows weighs as many draws as it has rows, but at most so many: large kinds don't crowd out small ones. Within a kind, all rows are drawn alike.
MOST_WEIGHT = 100
METRES = (100, 250, 500, 1_000, 2_000, 5_000, 10_000, 25_000, 50_000, 100_000, 200_000)
KM = (5, 10, 25, 50)
COUNTS = (1, 3, 5, 10)
# One plain wording per shape of query.
WORDING = {
    "lookup": "show {a}", "relate": "which {what} {how} {a}", "near": "which {what} lie within {metres} metres of {a}", "buffer": "draw a zone of {metres} metres around {a}", "both": "which {what} {how} both {a} and {b}", "near_union": "which {what} lie within {metres} metres of {all}", "chained": "which {what} {how} {a} and {meet} {meets}",
    "overlay": "{op} of {a} and {b}", "corridor": "show {km} km on each side of the border of {a} and {b}", "union": "merge {all} into one shape", "union_within": "merge the {what} of {a}", "countries": "list the {what} of {countries}", "half": "show the {side}ern half of {a}", "top": "the {n} {size} {subtype} areas of {a}",
    "rank": "the {size} {what} of each {per} in {country}", "attribute": "which {what} of {country} have {flag} {value}",
}


class Draw:
    """Callable for dataset.generate: (question, parameters, anchors) for a template and sample id, or None where no anchor fits.

    Rows are ranked by hash within their kind (pair of subtypes, subtype, or country); a draw is a kind and a rank, so every row
    of every table can be drawn. Only sizes of kinds and drawn rows are collected, the latter for all items at once by `prepare`.
    """

    def __init__(self, divisions: DataFrame, natural: DataFrame, relations: dict[str, DataFrame]):
        named = lambda df: df.where((F.trim("names.primary") != "") & F.col("geometry").isNotNull()).select("id", F.col("names.primary").alias("name"), "subtype", "country").dropDuplicates(["id"])
        kinds = {"containment": (["container_subtype", "contained_subtype"], ("container_id", "contained_id")), "adjacency": (["anchor_subtype", "target_subtype"], ("anchor_id", "target_id")), "cross_source": (["division_subtype", "natural_subtype"], ("division_id", "natural_id")), "common_neighbor": (["shared_neighbor_subtype"], ("anchor_id_1", "anchor_id_2", "shared_neighbor_id"))}
        kinds |= {"intersection": kinds["adjacency"], "coastal_containment": kinds["containment"], "landlocked_containment": kinds["containment"]}
        pools = {DA: (named(divisions), ["subtype"], ("id",)), NE: (named(natural), ["subtype"], ("id",)), "country": (named(divisions), ["country"], ("id",))}
        pools |= {name: (relations[name], *by) for name, by in kinds.items() if name in relations}
        self.ranked, self.kinds = {}, {name: [] for name in kinds}
        for name, (df, by, ids) in pools.items():
            kind = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by])
            ranked = hashed_rank(df.withColumn("_key", F.concat_ws("/", *ids)).withColumn("_kind", kind), ["_kind"], "draw", "_key", "_r").persist()
            self.ranked[name] = ranked
            self.kinds[name] = [(r["_kind"], r.asDict(), r["_n"]) for r in ranked.groupBy("_kind", *by).agg(F.count("*").alias("_n")).orderBy("_kind").collect()]
        self.countries = sorted(kind["country"] for _, kind, _ in self.kinds["country"] if kind["country"])
        self.drawn: dict[tuple[str, str, int], dict] = {}

    def _pick(self, name: str, roll: int, fits=None, n: int = 1) -> list[tuple[str, str, int]]:
        """`n` different rows (table, kind, rank from 1) of the kinds that fit, or none."""
        kinds = [(key, size) for key, kind, size in self.kinds[name] if fits is None or fits(kind)]
        if sum(size for _, size in kinds) < n:
            return []
        out = []
        for i in range(n):
            weights = [min(size, MOST_WEIGHT) if n == 1 else size for _, size in kinds]
            at = (roll + i) % sum(weights)
            for (key, size), weight in zip(kinds, weights):
                if at < weight:
                    # the roll's other digits choose among all rows of the kind
                    out.append((name, key, (roll // sum(weights) if n == 1 else at) % size + 1))
                    break
                at -= weight
        return out

    def _fetch(self, picks) -> None:
        missing: dict[str, set] = {}
        for name, kind, rank in picks:
            if (name, kind, rank) not in self.drawn:
                missing.setdefault(name, set()).add((kind, rank))
        for name, wanted in missing.items():
            ranked = self.ranked[name]
            asked = ranked.sparkSession.createDataFrame(sorted(wanted), "_kind string, _r long")
            for r in ranked.join(asked, ["_kind", "_r"]).collect():
                self.drawn[name, r["_kind"], r["_r"]] = r.asDict()

    def prepare(self, items: list[tuple[str, str, str]]) -> None:
        """Collects the rows that these (family, template, sample id) draw, with one join for each table."""
        self._fetch(pick for _, template_id, sample_id in items for pick in self._wanted(TEMPLATES[template_id], self._roll(TEMPLATES[template_id], sample_id))[0])

    @staticmethod
    def _roll(t: Template, sample_id: str) -> int:
        return int(hashlib.md5(f"{t.id}/{sample_id}".encode()).hexdigest(), 16)

    def _wanted(self, t: Template, roll: int) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, str]]]:
        """Rows to draw for the anchors, from the relation that makes an answer likely, and the (source, id, name) columns to read from each."""
        side = lambda prefix, source: (source, f"{prefix}_id", f"{prefix}_name")
        among = lambda column: lambda kind: not t.subtypes or kind[column] in t.subtypes
        subtypes, how = t.subtypes, t.options.get("how")
        if not t.anchors or t.shape == "countries":
            countries = self._countries(t, roll)
            return self._pick("country", roll, lambda kind: kind["country"] in countries) or self._pick("country", roll), [(DA, "id", "name")]
        if t.shape == "both":
            return self._pick("common_neighbor", roll, lambda kind: kind["shared_neighbor_subtype"] in subtypes), [(DA, f"anchor_id_{i}", f"anchor_name_{i}") for i in (1, 2)]
        if t.shape == "corridor":
            return self._pick("adjacency", roll), [side("anchor", DA), side("target", DA)]
        if t.shape == "overlay":
            if t.anchors[1] == NE:
                return self._pick("cross_source", roll), [side("division", DA), side("natural", NE)]
            overlapping = self._pick("intersection", roll)
            return (overlapping, [side("anchor", DA), side("target", DA)]) if overlapping else (self._pick("containment", roll), [side("container", DA), side("contained", DA)])
        if t.shape in ("union", "near_union"):
            has_counties = any(kind["subtype"] == "county" for _, kind, _ in self.kinds[DA])
            return self._pick(DA, roll, lambda kind: not has_counties or kind["subtype"] == "county", len(t.anchors)), [(DA, "id", "name")]
        if t.anchors == (NE,) and t.target == DA:
            return self._pick("cross_source", roll, among("division_subtype")), [side("natural", NE)]
        if t.target == NE and t.anchors == (DA,):
            return self._pick("cross_source", roll, among("natural_subtype")), [side("division", DA)]
        if t.family == "intersection" and t.anchors == (DA,):
            overlapping = self._pick("intersection", roll, among("target_subtype"))
            if overlapping:
                return overlapping, [side("anchor", DA)]
        if t.shape == "chained" and how in ("within", "intersects") and set(t.options["meets"]) <= set(SEA):
            shore = self._pick("landlocked_containment" if t.options.get("negated") else "coastal_containment", roll, among("contained_subtype"))
            if shore:
                return shore, [side("container", DA)]
        if how == "contains":
            return self._pick("containment", roll, lambda kind: kind["container_subtype"] in subtypes), [side("contained", DA)]
        if how == "within" or (t.shape == "chained" and how == "intersects"):
            return self._pick("containment", roll, among("contained_subtype")), [side("container", DA)]
        if how == "touches":
            return self._pick("adjacency", roll, among("target_subtype")), [side("anchor", DA)]
        return self._pick(t.anchors[0], roll), [(t.anchors[0], "id", "name")]

    def _countries(self, t: Template, roll: int) -> list[str]:
        return [self.countries[(roll + i) % len(self.countries)] for i in range(max(1, len(t.anchors)))] if self.countries else []

    def __call__(self, t: Template, sample_id: str):
        roll, countries = self._roll(t, sample_id), self.countries
        p: dict = {"metres": METRES[roll % (7 if t.shape == "near_union" else len(METRES))], "km": KM[roll % len(KM)], "n": COUNTS[roll % len(COUNTS)], "subtype": ("county", "region")[roll // 7 % 2]}
        if countries:
            p["country"], p["countries"] = countries[roll % len(countries)], self._countries(t, roll)
        picks, columns = self._wanted(t, roll)
        if not picks or (not countries and t.shape in ("countries", "rank", "attribute", "top")):
            return None
        self._fetch(picks)
        anchors = [(source, self.drawn[pick][i], self.drawn[pick][name]) for pick in picks for source, i, name in columns]
        p |= {f"anchor{i + 1}": a[1] for i, a in enumerate(anchors)} | {"ids": [a[1] for a in anchors]}
        o = t.options
        words = {"touches": "touch", "within": "lie within", "contains": "contain", "intersects": "meet"}
        text = WORDING[t.shape].format(
            a=anchors[0][2] if t.shape != "top" or t.anchors else p.get("country"), b=anchors[-1][2], all=", ".join(a[2] for a in anchors), what=" or ".join(t.subtypes) or "areas", how=words.get(o.get("how"), ""), op=o.get("op"), side=o.get("side"), per=o.get("per"), flag=o.get("flag"), value=o.get("value"),
            size="largest" if o.get("largest") else "smallest", meet="meet no" if o.get("negated") else "meet", meets=" or ".join(o.get("meets", ())), **{k: p.get(k) for k in ("metres", "km", "n", "subtype", "country")}, countries=", ".join(p.get("countries", [])),
        )
        return text, {k: p[k] for k in t.parameters}, anchors
