"""Running SQL written elsewhere: dialect, safety, retries with feedback, and the search pipeline as a stream of events.

Texts come in the dialect of an embedded analytics engine. Before Spark sees one, string literals are set aside, so rules never
touch their content; then names, functions, numbers and sort orders are rewritten to mean the same in Spark. Anything but a single
SELECT is refused, and anything the rules don't cover fails in Spark's parser and becomes feedback for the writer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.functions import call, register
from terralith.operators.spatial_join import spatial_join
from terralith.operators.search import candidates_per_source, merge_candidates, search_candidates
from terralith.plans import export
from terralith.plans.templates import sql as template_sql

ATTEMPTS = 5
#: What a candidate shows to a writer of SQL.
PROMPT_COLUMNS = ("source", "id", "name", "subtype", "country", "region", "admin_level")
# Subtype literals that writers capitalise, and the subtypes of one they invent.
CAPITALISED = ("River", "Lake", "Basin", "Range/mtn", "Peninsula", "Depression", "Island group", "Ocean", "Sea")
TERRAIN = ("range/mtn", "peninsula", "depression")
_CASTS = {"st_buffer": (1,), "st_makeenvelope": (0, 1, 2, 3), "st_simplifypreservetopology": (1,)}


class Refused(ValueError):
    """The text is no single read-only query."""


def strip_fences(text: str | None) -> str:
    """The code of a fenced block, or the text; without surrounding blanks and a final semicolon. Null gives an empty text."""
    text = (text or "").strip()
    fenced = re.search(r"```[a-zA-Z]*\s*\n?(.*?)(?:```|$)", text, re.DOTALL)
    return (fenced[1] if fenced else text).strip().rstrip(";").strip()


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose opening parenthesis is at `at`, and the place after its closing one."""
    depth, start, out = 0, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                out.append(text[start:i].strip())
                return out, i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise Refused("unbalanced parentheses")


def _calls(text: str, name: str, change: Callable[[list[str]], str]) -> str:
    """Replaces every call of a function, innermost last, by what `change` makes of its arguments."""
    pattern, at = re.compile(rf"\b{name}\s*\(", re.IGNORECASE), 0
    while m := pattern.search(text, at):
        arguments, end = _arguments(text, m.end() - 1)
        put = change([_calls(a, name, change) for a in arguments])
        text, at = text[: m.start()] + put + text[end:], m.start() + len(put)
    return text


def _order(text: str) -> str:
    """NULLS LAST for sort keys that don't say where nulls go."""

    def keys(m: re.Match) -> str:
        body, depth, end = m[2], 0, len(m[2])
        for i, c in enumerate(body):
            depth += (c == "(") - (c == ")")
            if depth < 0 or (depth == 0 and re.match(r"\b(LIMIT|ROWS|RANGE|UNION|OFFSET)\b", body[i:], re.IGNORECASE)):
                end = i
                break
        inside, rest = body[:end].rstrip(), body[end:]
        parts, depth, start = [], 0, 0
        for i, c in enumerate(inside + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(inside[start:i])
                start = i + 1
        parts = [p if re.search(r"\bNULLS\s+(FIRST|LAST)\s*$", p.strip(), re.IGNORECASE) or not p.strip() else p.rstrip() + " NULLS LAST" for p in parts]
        return m[1] + ",".join(parts) + (" " if rest[:1].isalpha() else "") + _order(rest)

    return re.sub(r"(\bORDER\s+BY\b)(.*)", keys, text, count=1, flags=re.IGNORECASE | re.DOTALL)


def translate(text: str) -> str:
    """The text in Spark's dialect. Raises Refused if it isn't one read-only query."""
    text = strip_fences(text)
    # what looks like a comment inside a literal or a quoted name is none
    text = re.sub(r"""'(?:[^']|'')*'|"[^"]*"|--[^\n]*|/\*.*?\*/""", lambda m: m[0] if m[0][0] in "'\"" else " ", text, flags=re.DOTALL)
    text = re.sub(r"""read_parquet\s*\(\s*['"][^'"]*divisions?_area[^'"]*['"]\s*\)""", "divisions_area", text, flags=re.IGNORECASE)
    text = re.sub(r"""read_parquet\s*\(\s*['"][^'"]*natural_earth[^'"]*['"]\s*\)""", "natural_earth", text, flags=re.IGNORECASE)
    for word in CAPITALISED:
        text = text.replace(f"'{word}'", f"'{word.lower()}'")
    text = re.sub(r"(\b\w+\.)?subtype\s*(?:=|IN\s*\()\s*'Terrain area'(?:\s*\))?", lambda m: f"{m[1] or ''}subtype IN ({', '.join(repr(s) for s in TERRAIN)})", text, flags=re.IGNORECASE)

    literals: list[str] = []

    def aside(m: re.Match) -> str:
        literals.append(m[0])
        return f"\x00{len(literals) - 1}\x00"

    text = re.sub(r"'(?:[^']|'')*'", aside, text)
    if not re.match(r"\s*(SELECT|WITH)\b", text, re.IGNORECASE) or ";" in text or re.search(r"\b(INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|COPY|ATTACH|INSTALL|LOAD|PRAGMA|SET|CALL|EXPORT)\b", text, re.IGNORECASE):
        raise Refused("only one SELECT statement is allowed")
    if re.search(r"\bread_\w+\s*\(", text, re.IGNORECASE):
        raise Refused("only divisions_area and natural_earth can be read")
    text = re.sub(r'"([^"]+)"', r"`\1`", text)
    text = re.sub(r"\*\s*REPLACE\s*\((.+?)\s+AS\s+(\w+)\)", r"* EXCEPT (\2), \1 AS \2", text, flags=re.IGNORECASE)
    text = re.sub(r"(?<![\w.\x00])(\d+\.\d+)(?![\w.])", r"\1D", text)
    text = re.sub(r"//", " div ", text)
    text = re.sub(r"::\s*BLOB\b", "::BINARY", re.sub(r"::\s*(VARCHAR|TEXT)\b", "::STRING", text, flags=re.IGNORECASE), flags=re.IGNORECASE)
    text = _calls(text, "st_union_agg", lambda a: f"st_union_list(collect_list({a[0]}))")
    text = _calls(text, "array_agg", lambda a: f"transform(collect_list(struct({a[0]} AS v)), s -> s.v)")
    for name, places in _CASTS.items():
        text = _calls(text, name, lambda a, name=name, places=places: f"{name}({', '.join(f'CAST({x} AS DOUBLE)' if i in places else x for i, x in enumerate(a))})")
    text = _calls(text, "st_geomfromwkb", lambda a: f"CAST({a[0]} AS BINARY)")
    text = _calls(text, "st_aswkb", lambda a: f"CAST({a[0]} AS BINARY)")
    text = _order(text)
    return re.sub(r"\x00(\d+)\x00", lambda m: literals[int(m[1])].replace("\\", "\\\\").replace("''", "\\'") if "''" in literals[int(m[1])] or "\\" in literals[int(m[1])] else literals[int(m[1])], text)


def run(spark, text: str) -> DataFrame:
    """The query's rows; views of the sources must be registered (see gazetteer.register_views). Raises what Spark's analysis raises."""
    register(spark)
    return spark.sql(_through_grid(spark, translate(text)))


_EXISTS = re.compile(
    r"\b(?P<no>NOT\s+)?EXISTS\s*\(\s*SELECT\s+\S+\s+FROM\s+(?P<inner>divisions_area|natural_earth)\s+(?:AS\s+)?(?P<i>\w+)\s+WHERE\s+(?:(?P<more>[^;]*?)\s+AND\s+)?ST_(?P<how>Intersects|Touches|Within|Contains)\s*\(\s*(?P<a>\w+)\.geometry\s*,\s*(?P<b>\w+)\.geometry\s*\)\s*\)",
    re.IGNORECASE,
)
_TURNED = {"intersects": "intersects", "touches": "touches", "within": "contains", "contains": "within"}


def _through_grid(spark, text: str) -> str:
    """Spatial semi- and anti-joins of two sources go through the grid join; the text then joins its keys by equality.

    As written they would run every row of one source against every row of the other. Conditions on the inner source stay with
    it; a condition that also names another table leaves the text as it is.
    """
    aliases = {m[2].lower(): m[1].lower() for m in re.finditer(r"\b(divisions_area|natural_earth)\s+(?:AS\s+)?(?!WHERE\b|ON\b|JOIN\b|ORDER\b|GROUP\b|LIMIT\b|UNION\b)(\w+)", text, re.IGNORECASE)}

    def put(m: re.Match) -> str:
        inner, a, b, how = m["i"].lower(), m["a"].lower(), m["b"].lower(), m["how"].lower()
        outer = b if a == inner else a
        named = {x.lower() for x in re.findall(r"\b(\w+)\s*\.", m["more"] or "")}
        if inner == outer or inner not in (a, b) or outer not in aliases or not named <= {inner, "names"} or (m["more"] or "").count("(") != (m["more"] or "").count(")"):
            return m[0]
        kept = spark.sql(f"SELECT geometry, xmin, ymin, xmax, ymax FROM {m['inner']} AS {m['i']} WHERE {m['more'] or 'true'}")
        rows = spark.sql(f"SELECT id, geometry, xmin, ymin, xmax, ymax FROM {aliases[outer]}")
        view = f"_met_{uuid.uuid4().hex}"
        spatial_join(rows, kept, how if a == outer else _TURNED[how], "left_semi").select("id").distinct().createOrReplaceTempView(view)
        return f"{m['no'] or ''}EXISTS (SELECT 1 FROM {view} WHERE {view}.id = {outer}.id)"

    return _EXISTS.sub(put, text)


def normalized_geometry(df: DataFrame, tolerance: float = 0.001, digits: int = 5) -> DataFrame:
    """Geometry columns (WKB, or GeoJSON text) simplified and rounded, as GeoJSON text; null where empty. Other texts stay."""
    register(df.sparkSession)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BinaryType):
            df = df.withColumn(f.name, call("st_geojson_simplified", F.col(f.name), tolerance, digits))
        elif f.name == "geometry" and isinstance(f.dataType, T.StringType):
            shaped = call("st_geojson_simplified", call("st_geomfromgeojson", F.col(f.name)), tolerance, digits)
            df = df.withColumn(f.name, F.when(F.col(f.name).startswith("{"), shaped).otherwise(F.col(f.name)))
    return df


def default_places(question: str) -> list[str]:
    """Runs of capitalised words; the whole question if there is none."""
    found = re.findall(r"[^\W\d_a-z][\w'’-]*(?:\s+(?:of\s+|de\s+)?[^\W\d_a-z][\w'’-]*)*", question)
    found = [f for f in found if f.lower() not in ("show", "find", "list", "which", "what", "draw", "the", "give", "locate")]
    return found or [question]


def default_sql(question: str, candidates: list[dict], previous: str | None, error: str | None) -> str:
    """A lookup of the best candidate."""
    best = candidates[0]
    return template_sql("lookup_01" if best["source"] == "divisions_area" else "lookup_02", anchor1=best["id"])


def search_events(spark, question: str, divisions: DataFrame, natural: DataFrame, places: Callable[[str], list[str]] = default_places, write_sql: Callable = default_sql, attempts: int = ATTEMPTS, ready: Callable[[], bool] | None = None) -> Iterator[dict]:
    """Answers a question step by step: events of type places, candidates, sql_attempt, sql_error, and at last geojson or error.

    An empty result counts as an error and is fed back; an exception of the writer uses an attempt up. `ready` says whether the
    writers can answer at once; if not, an event warming_up comes first.
    """
    if ready is not None and not ready():
        yield {"type": "warming_up", "data": "The model that writes queries is starting"}
    try:
        named = [p for p in places(question) if p and p.strip()] or [question]
    except Exception:  # an extractor that fails leaves the question as one place
        named = [question]
    yield {"type": "places", "data": named}
    k = candidates_per_source(len(named))
    merged = merge_candidates([search_candidates(divisions, natural, p, k) for p in named])
    found = [r.asDict() for r in merged.limit(2 * k * len(named)).collect()]
    found = [{c: (None if v != v else v) for c, v in r.items()} for r in found]
    if not found:
        yield {"type": "error", "data": "No candidates found"}
        return
    yield {"type": "candidates", "data": found}
    shown = [{c: r.get(c) for c in PROMPT_COLUMNS} for r in found]
    previous = error = None
    for n in range(1, attempts + 1):
        try:
            text = strip_fences(write_sql(question, shown, previous, error))
        except Exception as problem:
            error = f"writing the query failed: {problem}"
            yield {"type": "sql_error", "data": error, "iteration": n}
            continue
        yield {"type": "sql_attempt", "data": text, "iteration": n}
        try:
            result = normalized_geometry(run(spark, text))
            collection = export.to_feature_collection(result)
            if not collection["features"]:
                raise ValueError("The query returned no rows")
        except Exception as problem:
            previous, error = text, str(problem)[:2000]
            yield {"type": "sql_error", "data": error, "iteration": n}
            continue
        yield {"type": "geojson", "data": collection, "iteration": n}
        return
    yield {"type": "error", "data": "No result from SQL"}


def search(spark, question: str, divisions: DataFrame, natural: DataFrame, **options) -> dict:
    """The last state of search_events: {geojson, sql, places, candidates}. LookupError if there is no result."""
    out: dict = {"geojson": None, "sql": None, "places": [], "candidates": []}
    names = {"sql_attempt": "sql", "geojson": "geojson", "places": "places", "candidates": "candidates"}
    for event in search_events(spark, question, divisions, natural, **options):
        if event["type"] in names:
            out[names[event["type"]]] = event["data"]
    if out["geojson"] is None:
        raise LookupError("no result")
    return out
