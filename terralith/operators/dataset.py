"""Question-and-SQL datasets: candidate lists, validation, statistics, splits, export, evaluation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.ranking import hashed_rank
from terralith.operators.search import distractors
from terralith.plans.templates import TEMPLATES, by_family
from terralith.plans.templates import sql as template_sql

SPLITS = (("train", 0.8), ("val", 0.1))  # the rest is test
#: Patterns of questions, by families ("" for all), with what they may become; groups carry over what they hold.
REWORDINGS = [
    ("", r"^(?:please )?(?:show|display|draw) (?:me )?(.+?)[.?]?$", ["I need \\1.", "Could you map \\1?", "\\1, please."]),
    ("", r"^(?:which|what) (\w+) (.+?)\?$", ["List every \\1 that would \\2.", "Tell me the \\1 which \\2."]),
    ("", r"\bwithin (\d[\d.,]*) (km|kilometres|kilometers) of (.+)$", ["no farther than \\1 \\2 from \\3", "up to \\1 \\2 away from \\3"]),
    ("adjacency multi_adjacency", r"\b(?:touch|border|adjoin)(es|s)? (.+)$", ["lie right beside \\2", "meet the edge of \\2"]),
    ("containment chained", r"\b(?:inside|within|in) ([A-Z].+)$", ["that belong to \\1", "enclosed by \\1"]),
    ("intersection", r"\b(?:crossed by|intersecting|that intersect) (.+)$", ["through which \\1 runs", "that \\1 passes"]),
    ("buffer border_corridor", r"\b(?:area|zone) (?:around|along) (.+)$", ["surroundings of \\1", "belt about \\1"]),
    ("aggregation window_function", r"\b(?:largest|biggest) (.+)$", ["most extensive \\1", "\\1 of the greatest area"]),
    ("difference set_operations partial_selection", r"\bwithout (.+)$", ["leaving out \\1", "minus \\1"]),
]


def candidate_list(divisions: DataFrame, natural: DataFrame, anchors: DataFrame, n: int, anchor_name: str, anchor_source: str, anchor_id: str) -> DataFrame:
    """Candidates of a question: the true anchors first (similarity 1), then distractors, each id once, at most n, numbered c1, c2, ..."""
    from terralith.operators.search import interleave

    true = anchors.withColumn("similarity", F.lit(1.0)).withColumn("position", F.lit(0))
    others = distractors(divisions, natural, anchor_name, anchor_source, anchor_id, n)
    one = others.withColumn("_one", F.lit(1))
    from pyspark.sql import Window

    others = one.withColumn("position", F.row_number().over(Window.partitionBy("_one").orderBy(F.desc("similarity"), "source", "id"))).drop("_one")  # n rows
    columns = ["source", "id", "name", "subtype", "country", "region", "admin_level", "similarity", "position"]
    return interleave([true.select(*columns), others.select(*columns)], n, key=("id",)).select("candidate_id", "source", "id", "name", "subtype", "country", "region", "admin_level", "similarity")


def validate(samples: DataFrame) -> DataFrame:
    """Adds `issues`, an array: no candidates, a selection that is no candidate, repeated candidate ids, an empty question. Valid samples have an empty array."""
    ids = F.transform("candidates", lambda c: c["candidate_id"])
    features = F.transform("candidates", lambda c: c["id"])
    checks = [
        (F.coalesce(F.size("candidates"), F.lit(0)) <= 0, "no candidates"),
        (F.coalesce(F.size(F.array_except("target.selected_candidates", ids)), F.lit(0)) > 0, "selected candidate not in list"),
        (F.coalesce(F.size(F.array_distinct(features)) < F.size(features), F.lit(False)), "duplicate candidates"),
        (F.coalesce(F.trim(F.regexp_replace("question", r"\s+", " ")), F.lit("")) == "", "empty question"),
    ]
    return samples.withColumn("issues", F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull()))


def statistics(samples: DataFrame) -> DataFrame:
    """Counts by family, difficulties and anchor source in one pass (grouping sets): dimension, value, samples, candidates and words on average."""
    words = F.size(F.filter(F.split(F.trim("question"), r"\s+"), lambda w: w != ""))
    fields = ("task_family", "sql_difficulty", "grounding_difficulty", "anchor_source")
    long = samples.select(F.explode(F.array(*[F.struct(F.lit(f).alias("dimension"), F.col(f"metadata.{f}").alias("value")) for f in fields], F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")))).alias("d"), F.size("candidates").alias("n"), words.alias("w"))
    return long.groupBy("d.dimension", "d.value").agg(F.count("*").alias("samples"), F.round(F.avg("n"), 6).alias("avg_candidates"), F.round(F.avg("w"), 6).alias("avg_words"))


def coverage(samples: DataFrame) -> DataFrame:
    """Countries and subtypes of selected candidates, sorted: kind, value."""
    chosen = samples.select(F.explode(F.filter("candidates", lambda c: F.array_contains("target.selected_candidates", c["candidate_id"]))).alias("c"))
    pairs = chosen.select(F.explode(F.array(F.struct(F.lit("country").alias("kind"), F.col("c.country").alias("value")), F.struct(F.lit("subtype").alias("kind"), F.col("c.subtype").alias("value")))).alias("p")).select("p.kind", "p.value")
    return pairs.where("value <> ''").distinct()


def stratified_split(rows: DataFrame, stratum: str, id_column: str = "id", seed: str = "42") -> DataFrame:
    """Adds `split`: of each stratum int(0.8 n) rows to train, int(0.1 n) to val, the rest to test, in the order of a hash of the id."""
    ranked = hashed_rank(rows, [stratum], seed, id_column, "_r")
    first = F.floor(F.col("_r_of") * SPLITS[0][1] + 1e-9)
    second = first + F.floor(F.col("_r_of") * SPLITS[1][1] + 1e-9)
    return ranked.withColumn("split", F.when(F.col("_r") <= first, "train").when(F.col("_r") <= second, "val").otherwise("test")).drop("_r", "_r_of")


def candidates_csv():
    """The candidates of a sample as CSV text (built-in functions), ordered by a hash so that position tells nothing."""
    cell = lambda c: F.when(c.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    fields = ("source", "id", "name", "subtype", "country", "region", "admin_level")
    shuffled = F.transform(F.array_sort(F.transform("candidates", lambda c: F.struct(F.md5(F.concat(F.col("id"), c["candidate_id"])).alias("h"), c.alias("c")))), lambda s: s["c"])
    lines = F.transform(shuffled, lambda c: F.concat_ws(",", *[cell(c[f].cast("string")) for f in fields]))
    return F.concat(F.lit(",".join(fields) + "\n"), F.array_join(lines, "\n"))


def sql_pairs(samples: DataFrame, system: str = "Write one read-only spatial SQL query over the candidates.") -> DataFrame:
    """(id, messages, metadata): conversations from candidates and question to the statement. Samples without a statement give none."""
    user = F.concat(F.lit("<CANDIDATES>\n"), candidates_csv(), F.lit("\n</CANDIDATES>\n\n<USER_QUERY>\n"), F.coalesce("question", F.lit("")), F.lit("\n</USER_QUERY>"))
    statement = F.trim(F.regexp_replace(F.col("target.sql"), r"read_parquet\('[^']*?(divisions_area|natural_earth)[^']*'\)", "read_parquet('$1')"))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return samples.where(F.trim("target.sql") != "").select("id", F.array(said("system", F.lit(system)), said("user", user), said("assistant", statement)).alias("messages"), "metadata")


def place_pairs(samples: DataFrame, system: str = "List the places named in the question.") -> DataFrame:
    """(id, messages, metadata): conversations from question to the selected places' names, in order, each once ignoring case."""
    names = F.filter(F.transform("target.selected_candidates", lambda x: F.trim(F.get(F.filter("candidates", lambda c: c["candidate_id"] == x), F.lit(0))["name"])), lambda n: n.isNotNull() & (n != ""))
    once = F.filter(names, lambda n, i: F.array_position(F.transform(names, lambda m: F.lower(m)), F.lower(n)) == i + 1)
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    answer = F.to_json(F.struct(F.transform(once, lambda n: F.struct(n.alias("place"))).alias("places")))
    return samples.where(F.size(once) > 0).select("id", F.array(said("system", F.lit(system)), said("user", F.coalesce("question", F.lit(""))), said("assistant", answer)).alias("messages"), "metadata")


def user_query(messages):
    """The question in a conversation: what stands between <USER_QUERY> tags of the last message but one, else its first 120 letters."""
    content = F.element_at(messages, -2)["content"]
    inside = F.trim(F.regexp_extract(content, r"(?s).*<USER_QUERY>\s*(.*?)\s*(?:</USER_QUERY>|$)", 1))
    return F.when(content.contains("<USER_QUERY>"), inside).otherwise(F.substring(content, 1, 120))


def evaluated(results: DataFrame, task: str | None = None, split: str | None = None, label: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Results of one task, split, label and of the given ids; what is not named does not restrict, and a column that is not there holds nothing."""
    for name, value in (("task", task), ("split", split), ("label", label)):
        if value is not None:
            results = results.where(F.col(name) == value) if name in results.columns else results.limit(0)
    return results if ids is None else results.where(F.col("id").cast("string").isin(*ids))


def one_per_country(candidates: DataFrame, order: str = "position") -> DataFrame:
    """Of candidates that are countries, the first of each country code; of others, the first of each id; numbered c1, c2, ... anew."""
    key = F.when((F.col("subtype") == "country") & F.col("country").isNotNull(), F.concat(F.lit("country:"), F.col("country"))).otherwise(F.concat(F.lit("id:"), F.col("id")))
    from pyspark.sql import Window

    first = candidates.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(order))).where("_n = 1").drop("_n", "_key")
    place = F.row_number().over(Window.partitionBy("_one").orderBy(order))  # the candidates of one question
    return first.withColumn("_one", F.lit(1)).withColumn("candidate_id", F.concat(F.lit("c"), place.cast("string"))).drop("_one")


def length_exceedance(lengths: DataFrame, column: str, limits=(1024, 2048, 4096)) -> DataFrame:
    """Rows longer than each limit, and their share in percent; one pass, counted before anything is shuffled."""
    n = F.col(column)
    sums = lengths.where(n.isNotNull()).agg(F.count("*").alias("all"), *[F.count(F.when(n > x, 1)).alias(f"over_{x}") for x in limits])
    return sums.select("all", F.expr("inline(array(" + ", ".join(f"struct({x} AS upper, over_{x} AS over)" for x in limits) + "))")).select("upper", "over", F.round(100.0 * F.col("over") / F.col("all"), 6).alias("percent"))


_CLAUSES = re.compile(r"\s+(?=(?:FROM|WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|UNION(?:\s+ALL)?|(?:LEFT\s+|INNER\s+|CROSS\s+)?JOIN)\b)", re.IGNORECASE)
_WORDS = "select from where group by having order limit union all join left inner cross on as and or not in exists with is null between like desc asc case when then else end over partition distinct"


def pretty_sql(text: str) -> str:
    """A statement with a clause per line, conditions indented below it, and key words in capitals. Literals and quoted names stay as they are."""
    parts = re.split(r"""('(?:[^']|'')*'|"[^"]*")""", text.strip())
    keys = re.compile(r"\b(?:" + "|".join(_WORDS.split()) + r")\b", re.IGNORECASE)
    plain = "".join(p if i % 2 else keys.sub(lambda m: m[0].upper(), re.sub(r"\s+", " ", p)) for i, p in enumerate(parts))
    held = re.split(r"""('(?:[^']|'')*'|"[^"]*")""", plain)
    return "".join(p if i % 2 else re.sub(r"\s+(?=(?:AND|OR)\b)", "\n    ", _CLAUSES.sub("\n", p)) for i, p in enumerate(held))


def exact_match(results: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row: samples, exact matches of trimmed texts, and their rate (0 for none)."""
    same = F.coalesce(F.trim(expected) == F.trim(predicted), F.lit(False)).cast("int")
    return results.agg(F.count("*").alias("num_samples"), F.coalesce(F.sum(same), F.lit(0)).alias("exact_matches"), F.coalesce(F.avg(same), F.lit(0.0)).alias("exact_match_rate"))


def length_summary(lengths: DataFrame, column: str, quantiles=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """min, max, mean and quantiles by index (the value at int(n * q) of the sorted lengths), from counts per length: no list of all values is made."""
    from pyspark.sql import Window

    counts = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")).withColumn("one", F.lit(1))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("one").orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy("one")))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v"))).alias(f"p{int(q * 100)}") for q in quantiles]
    return upto.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), *picks)


def length_histogram(lengths: DataFrame, column: str, edges=(512, 1024, 2048, 4096, 8192)) -> DataFrame:
    """Rows per bucket (upper bound, null beyond the last) and their share in percent."""
    bucket = None
    for e in edges:
        bucket = F.when(F.col(column) <= e, e) if bucket is None else bucket.when(F.col(column) <= e, e)
    counts = lengths.where(F.col(column).isNotNull()).groupBy(bucket.alias("upper")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("upper", "rows", F.round(100.0 * F.col("rows") / F.col("total"), 6).alias("percent"))  # a row beside at most six


def work_items(targets: dict[str, int], retries: int = 2, seed: str = "42") -> list[tuple[str, str, str]]:
    """(family, template, sample id) to try: a family's target evenly over its templates, the first ones taking the remainder, each tried `retries` times, in hash order."""
    import hashlib

    out = []
    for family, target in targets.items():
        templates = by_family(family)
        for i, t in enumerate(templates):
            share = target // len(templates) + (i < target % len(templates))
            out += [(family, t.id) for _ in range(share * retries)]
    items = [(f, t, f"sample_{i:06d}") for i, (f, t) in enumerate(out)]
    return sorted(items, key=lambda x: hashlib.md5((seed + x[2]).encode()).hexdigest())


def reword(question: str, family: str, key: str) -> tuple[str, list[str]]:
    """A question in slightly other words, chosen by a hash of `key`: unchanged in about a third of cases, else one or two rewordings."""
    import hashlib

    roll = int(hashlib.md5(key.encode()).hexdigest(), 16)
    if not question or roll % 100 < 35:
        return question, []
    done = []
    for step in range(1 + (roll // 100) % 2):
        fits = [(pattern, put) for of, pattern, puts in REWORDINGS if not of or family in of.split() for put in puts if re.search(pattern, question, re.IGNORECASE)]
        if not fits:
            break
        pattern, put = fits[(roll // 1000 + step) % len(fits)]
        question = re.sub(r"\s+", " ", re.sub(pattern, put, question, count=1, flags=re.IGNORECASE)).strip()
        done.append(f"{family}:{pattern}")
    return question, done


def generate(spark, divisions: DataFrame, natural: DataFrame, items: list[tuple[str, str, str]], draw, n_candidates: int = 5) -> tuple[list[dict], dict]:
    """Samples for work items, and how the run went: draws parameters, writes the statement, runs it and keeps what gives rows.

    `draw(template, sample_id)` gives (question, parameters, anchors: list of (source, id, name)) or None; if it has `prepare`,
    that is given all items first. The statement runs on the registered views; failures and empty results are counted (tried, made, undrawn, failed, empty, rate), as the caller tries more items than it needs.
    """
    from terralith.plans import gateway

    if hasattr(draw, "prepare"):
        draw.prepare(items)
    out, outcome = [], {"tried": 0, "undrawn": 0, "failed": 0, "empty": 0}
    for family, template_id, sample_id in items:
        outcome["tried"] += 1
        drawn = draw(TEMPLATES[template_id], sample_id)
        if drawn is None:
            outcome["undrawn"] += 1
            continue
        question, parameters, anchors = drawn
        statement = template_sql(template_id, **parameters)
        try:
            if gateway.run(spark, statement).limit(1).isEmpty():
                outcome["empty"] += 1
                continue
        except Exception:
            outcome["failed"] += 1
            continue
        source, anchor_id, name = anchors[0]
        wanted = {(s, i) for s, i, _ in anchors}
        frames = [(divisions if s == "divisions_area" else natural).where(F.col("id").isin(*[i for t, i in wanted if t == s])).withColumn("source", F.lit(s)).withColumn("name", F.col("names.primary")) for s in {s for s, _ in wanted}]
        true = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)
        candidates = [r.asDict() for r in candidate_list(divisions, natural, true, max(n_candidates, len(anchors)), name, source, anchor_id).collect()]
        chosen = [c["candidate_id"] for c in candidates if (c["source"], c["id"]) in wanted]
        text, variants = reword(question, family, sample_id)
        t = TEMPLATES[template_id]
        sources = {s for s, _ in wanted}
        out.append({"id": sample_id, "question": text, "candidates": candidates, "target": {"selected_candidates": chosen, "sql": statement}, "metadata": {"task_family": family, "sql_difficulty": t.difficulty, "grounding_difficulty": "easy" if len(anchors) == 1 else "medium", "template_id": template_id, "num_candidates": len(candidates), "anchor_source": sources.pop() if len(sources) == 1 else "mixed", "sql_verified": True, "surface_variants": variants}})
    return out, outcome | {"made": len(out), "rate": round(len(out) / len(items), 6) if items else 0.0}


