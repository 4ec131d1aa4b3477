"""Problem 3: freely typed values mapped to the entries of a reference list, by a partition-based pigeonhole join. SQL only.

A reference string is cut into k+1 segments. A value within k edits of it holds at least one segment unchanged, displaced by
at most k positions, so an equality join on (reference length, segment number, substring) finds every such pair; the built-in
`levenshtein` then verifies. Each distinct spelling is looked up once, however often it was typed, so a value that a third of
all rows name costs one row in the join. The list's side is broadcast only if a count proves it small.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.joins import salted_join
from terralith.session import broadcast_if_small, cut, id_key, table

#: Segment rows of a reference list that may be broadcast (a row is about 60 bytes); a longer list is joined by a shuffle.
BROADCAST_SEGMENTS = 100_000
#: Letters whose decomposition has no base letter of its own.
PLAIN = {"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ı": "i", "ŧ": "t", "æ": "ae", "œ": "oe", "ß": "ss"}


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the base letters they decompose to, by rule."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        base = unicodedata.normalize("NFKD", low)[0] if len(low) == 1 else ""
        if base != chr(code) and "a" <= base <= "z":
            pairs[chr(code)] = base
    pairs |= {k: v for k, v in PLAIN.items() if len(v) == 1}
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _folding()


def mend(text):
    """UTF-8 that was read as Latin-1 or Windows-1252, read as UTF-8 again where that gives valid text."""
    again = F.decode(F.expr("encode(translate({0}, '€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ', '\u0080\u0082\u0083\u0084\u0085\u0086\u0087\u0088\u0089\u008a\u008b\u008c\u008e\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0098\u0099\u009a\u009b\u009c\u009e\u009f'), 'ISO-8859-1')".format(text)), "UTF-8")
    return F.when(F.expr(f"{text} rlike '[ÃÂÄÅ][\u0080-¿€-™]'"), again).otherwise(F.expr(text))


def fold(column):
    """Lower case without accents, punctuation and repeated spaces."""
    low = F.regexp_replace(F.lower(column), r"\p{M}+", "")
    for letter, plain in PLAIN.items():
        if len(plain) > 1:
            low = F.replace(low, F.lit(letter), F.lit(plain))
    return F.trim(F.regexp_replace(F.translate(low, _FROM, _TO), r"[^\p{L}\p{N}]+", " "))


def _fitting(values: DataFrame, refs: DataFrame, value: str, ref: str, k: int) -> DataFrame:
    """Values whose length is within `k` of some reference's: others match nothing, however long they are."""
    lengths = refs.select(F.explode(F.sequence(F.length(ref) - k, F.length(ref) + k)).alias("_fit")).distinct()
    return values.join(F.broadcast(lengths), F.length(value) == F.col("_fit"), "left_semi")  # as many rows as there are lengths


def pigeonhole_pairs(values: DataFrame, refs: DataFrame, k: int, value: str = "value", ref: str = "ref", short: bool = True) -> DataFrame:
    """All pairs (value, ref, distance) of distinct strings at most `k` edits apart.

    values, refs: one string column each (named by `value` and `ref`); nulls and strings of k characters or less give no pair
    unless equal (`short` = False leaves these out too). Equal strings pair at distance 0. An empty side gives no rows.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    r = refs.where(F.col(ref).isNotNull()).select(F.col(ref).alias("_r")).distinct()
    v = _fitting(values.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")), r, "_v", "_r", k).distinct()
    parts = k + 1
    cut_ = f"struct(_n AS _n, i AS _i, substring(_r, CAST(i * (_n DIV {parts}) + greatest(0, i - ({parts} - _n % {parts})) AS INT) + 1, CAST(_n DIV {parts} AS INT) + IF(i >= {parts} - _n % {parts}, 1, 0)) AS _s)"
    segments = r.select("_r", F.length("_r").alias("_n")).where(F.col("_n") > k).select("_r", F.expr(f"inline(transform(sequence(0, {k}), i -> {cut_}))"))
    # a segment that starts at p in the reference starts within (k - d) / 2 before and (k + d) / 2 after p in a value d longer
    base, extra = "(n DIV {p})".format(p=parts), "(n % {p})".format(p=parts)
    probe = (
        f"flatten(transform(filter(sequence(_m - {k}, _m + {k}), n -> n > {k}), n -> flatten(transform(sequence(0, {k}), i -> "
        f"transform(filter(sequence(CAST(i * {base} + greatest(0, i - ({parts} - {extra})) AS INT) - CAST(({k} - (_m - n)) DIV 2 AS INT), CAST(i * {base} + greatest(0, i - ({parts} - {extra})) AS INT) + CAST(({k} + (_m - n)) DIV 2 AS INT)), "
        f"p -> p >= 0 AND p + {base} + IF(i >= {parts} - {extra}, 1, 0) <= _m), "
        f"p -> struct(n AS _n, i AS _i, substring(_v, CAST(p AS INT) + 1, CAST({base} AS INT) + IF(i >= {parts} - {extra}, 1, 0)) AS _s))))))"
    )
    probes = v.select("_v", F.length("_v").alias("_m")).where(F.col("_m") > 0).select("_v", F.expr(f"inline({probe})"))
    pairs = probes.join(broadcast_if_small(segments, BROADCAST_SEGMENTS), ["_n", "_i", "_s"]).where(F.expr(f"levenshtein(_v, _r, {k}) >= 0")).select("_v", "_r")
    if short:
        pairs = pairs.unionByName(v.where(F.length("_v") <= k).join(r.where(F.length("_r") <= k), F.col("_v") == F.col("_r")).select("_v", "_r"))
    return pairs.distinct().select(F.col("_v").alias(value), F.col("_r").alias(ref), F.levenshtein("_v", "_r").alias("distance"))


def swapped_pairs(values: DataFrame, refs: DataFrame, value: str = "value", ref: str = "ref", slips: int = 2) -> DataFrame:
    """Pairs (value, ref, distance) that neighbours swapped by a slip of the fingers keep apart: one swap and at most one edit, or two swaps.

    A swap is one slip but two edits, so `pigeonhole_pairs` with k = 2 misses these. Every value of more than three letters is tried with each pair of
    neighbours swapped back (pigeonhole join with k = 1), and with each two such pairs (equality join). With `slips` = 1 one swap alone counts.
    """
    swap = lambda text, i: f"concat(substring({text}, 1, {i} - 1), substring({text}, {i} + 1, 1), substring({text}, {i}, 1), substring({text}, {i} + 2))"
    v = _fitting(values.where(F.length(value) > 3).select(F.col(value).alias("_value")), refs, "_value", ref, 1).distinct()
    once = v.select("_value", F.explode(F.expr(f"array_distinct(transform(sequence(1, length(_value) - 1), i -> {swap('_value', 'i')}))")).alias("_swapped"))
    near = once.join(pigeonhole_pairs(once.select(F.col("_swapped").alias("_s")), refs, 1, "_s", ref, short=False), F.col("_swapped") == F.col("_s")).select("_value", ref, (F.col("distance") + 1).alias("distance"))
    if slips < 2:
        return near.where("distance = 1").groupBy(F.col("_value").alias(value), ref).agg(F.min("distance").alias("distance"))
    twice = v.select("_value", F.explode(F.expr(f"flatten(transform(sequence(1, length(_value) - 3), i -> transform(sequence(i + 2, length(_value) - 1), j -> {swap(swap('_value', 'i'), 'j')})))")).alias("_swapped"))
    same = twice.join(broadcast_if_small(refs.select(F.col(ref)), BROADCAST_SEGMENTS), F.col("_swapped") == F.col(ref)).select("_value", ref, F.lit(2).alias("distance"))
    return near.unionByName(same).groupBy(F.col("_value").alias(value), ref).agg(F.min("distance").alias("distance"))


# Generic words of place names and what they say about the subtype.
GENERIC = {
    "river": "river", "rio": "river", "riviere": "river", "fluss": "river", "fleuve": "river", "r": "river", "riv": "river",
    "lake": "lake", "lac": "lake", "lago": "lake", "see": "lake", "l": "lake", "laguna": "lake", "lk": "lake",
    "bay": "bay", "bahia": "bay", "baie": "bay", "bucht": "bay", "b": "bay",
    "gulf": "gulf", "golfo": "gulf", "golfe": "gulf", "golf": "gulf", "g": "gulf",
    "strait": "strait", "estrecho": "strait", "detroit": "strait", "strasse": "strait", "str": "strait", "straits": "strait", "meerenge": "strait",
    "islands": "island group", "island": "island group", "isl": "island group", "islas": "island group", "iles": "island group", "inseln": "island group", "is": "island group", "isles": "island group",
    "range": "range/mtn", "rge": "range/mtn", "mount": "range/mtn", "mt": "range/mtn", "monte": "range/mtn", "mont": "range/mtn", "mountains": "range/mtn", "sierra": "range/mtn", "gebirge": "range/mtn", "cordillera": "range/mtn", "berg": "range/mtn", "chaine": "range/mtn", "mts": "range/mtn", "mtn": "range/mtn",
    "peninsula": "peninsula", "pen": "peninsula", "halbinsel": "peninsula", "presquile": "peninsula", "peninsule": "peninsula",
    "basin": "basin", "becken": "basin", "cuenca": "basin", "bassin": "basin", "bas": "basin",
    "depression": "depression", "depresion": "depression", "senke": "depression", "dep": "depression",
    "county": "county", "co": "county", "district": "county", "condado": "county", "comte": "county", "kreis": "county", "distrito": "county", "dist": "county", "landkreis": "county",
    "region": "region", "province": "region", "prov": "region", "provincia": "region", "provinz": "region", "state": "region",
    "country": "country", "republic": "country", "republica": "country", "republique": "country", "republik": "country", "kingdom": "country", "nation": "country", "land": "country",
}
#: Words of names that tell one place from another, with their abbreviations.
MODIFIERS = {"n": "north", "s": "south", "e": "east", "w": "west", "st": "saint", "ste": "saint", "nth": "north", "sth": "south", "nw": "new", "nord": "north", "sur": "south", "sud": "south"}


def _words(mapping: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def typed_parts(typed: DataFrame, text: str) -> DataFrame:
    """Adds `_tokens`, the folded words of the part of a typed value that names the place, and `_tail`, what follows it.

    What stands in brackets, after a comma, a slash, or the word "in" is the tail: it may name a country.
    """
    plain = F.regexp_replace(mend(f"`{text}`"), r"[\s ​-‏﻿]+", " ")
    head = F.regexp_extract(plain, r"(?i)^\W*(.*?\w.*?)\s*(?:[,/(\[|;]|\s-\s|\sin\s+|$)", 1)
    tail = F.regexp_extract(plain, r"(?i)^\W*.*?\w.*?\s*(?:[,/(\[|;]|\s-\s|\sin\s+)(.*)$", 1)
    words = F.split(fold(head), " ")
    full = F.transform(words, lambda w, i: F.when((i + 1 < F.size(words)) & F.array_contains(F.array(*[F.lit(k) for k in MODIFIERS]), w), F.element_at(_words(MODIFIERS), w)).otherwise(w))
    return typed.withColumn("_tokens", F.filter(full, lambda w: w != "")).withColumn("_tail", fold(tail))


def map_to_canonical(typed: DataFrame, canonical: DataFrame, k: int = 2, text: str = "text", country: str = "country") -> DataFrame:
    """For each row of `typed`, the entry of `canonical` (canonical_id, name, subtype, country) that its text means, or 0.

    A text matches an entry if some of its neighbouring words, written together, are within `k` edits of the entry's name
    without its generic word (River, Gulf of, ...), or the whole text is within `k` edits of the whole name. Of several
    matches the nearest is taken; between entries alike in distance decide, in this order: a generic word in the text, the
    country written in the text, the country beside it, a division before a natural feature, the smaller canonical_id.
    Null and blank texts, and texts that match nothing, get 0. Repeated rows are each kept. An empty list gives 0 everywhere.
    The result has the columns of `typed` and canonical_id; columns of `typed` that begin with an underscore are not allowed.
    """
    entries = canonical.where(F.col("canonical_id").isNotNull() & F.col("name").isNotNull()).select(
        F.col("canonical_id").cast("long").alias("_id"), fold(F.col("name")).alias("_full"), F.lower(F.trim("subtype")).alias("_subtype"), F.upper(F.trim("country")).alias("_at")
    )
    generic = F.array(*[F.lit(x) for x in [*GENERIC, "of", "de", "the"]])
    core = F.array_join(F.filter(F.split("_full", " "), lambda w: ~F.array_contains(generic, w)), "")
    entries = entries.withColumn("_core", F.when(core != "", core).otherwise(F.replace(F.col("_full"), F.lit(" "), F.lit("")))).withColumn("_joined", F.replace(F.col("_full"), F.lit(" "), F.lit(""))).where("_joined <> ''").distinct()

    entries = cut(entries)
    asked = typed.select(F.col(text).alias("_text"), F.col(country).alias("_given")).where(F.trim("_text") != "").distinct()
    # the distinct spellings feed several joins: written once to the shared folder
    asked = cut(typed_parts(asked, "_text").withColumn("_head", F.xxhash64("_tokens")).withColumn("_place", F.replace(F.col("_tail"), F.lit(" "), F.lit(""))))
    heads = asked.where("size(_tokens) > 0").groupBy("_head").agg(F.first("_tokens").alias("_tokens"))
    # a name written apart more than the list writes it has a few words more
    longest = (entries.agg(F.max(F.size(F.split("_full", " ")))).first()[0] or 1) + k
    # windows carry no text but their own, so that long texts cost no more than their length
    windows = heads.select("_head", F.expr(f"inline(flatten(transform(sequence(1, size(_tokens)), i -> transform(sequence(i, least(size(_tokens), i + {longest - 1})), j -> struct(array_join(slice(_tokens, i, j - i + 1), '') AS _window, i AS _from, j - i + 1 AS _count)))))"))
    names = cut(entries.select(F.col("_core").alias("ref")).union(entries.select("_joined")).distinct())
    windows = cut(_fitting(windows, names, "_window", "ref", k))
    # places and what stands behind them are looked up together
    looked_up = windows.select(F.col("_window").alias("value")).union(asked.where("_place <> ''").select("_place"))
    # a name of 2k letters or less is another name after k edits: it must be written as it is
    sure = (F.length("ref") > 2 * k) & (F.length("value") > 2 * k) | (F.col("distance") == 0)
    pairs = cut(pigeonhole_pairs(looked_up, names, k).where(sure))
    if k:
        # spellings that no edit explains are tried for swapped neighbours
        open_ = windows.join(windows.join(pairs, F.col("_window") == F.col("value")).select("_head").distinct(), "_head", "left_anti")
        pairs = pairs.unionByName(cut(swapped_pairs(open_.where(F.length("_window") > 2 * k).select(F.col("_window").alias("value")), names, slips=k).where(sure)))
    hits = windows.join(pairs, F.col("_window") == F.col("value")).join(heads, "_head")
    hits = hits.withColumn("_all", F.col("_count") == F.size("_tokens")).withColumn("_rest", F.expr("concat(slice(_tokens, 1, _from - 1), slice(_tokens, _from + _count, size(_tokens)))")).drop("_tokens")
    by_core = entries.select("*", F.col("_core").alias("ref"), F.lit(False).alias("_whole"))
    by_name = entries.where("_joined <> _core").select("*", F.col("_joined").alias("ref"), F.lit(True).alias("_whole"))
    modifiers = F.array(*[F.lit(x) for x in sorted({*MODIFIERS.values(), "old", "upper", "lower", "great", "little"})])
    hits = hits.join(broadcast_if_small(by_core.unionByName(by_name), BROADCAST_SEGMENTS), "ref").where(F.col("_all") | ~F.col("_whole"))
    # a modifier left over means another place
    hits = hits.where(~F.arrays_overlap("_rest", modifiers))
    said = F.filter(
        F.transform(
            F.col("_rest"),
            lambda w: F.coalesce(
                F.element_at(_words(GENERIC), w),
                F.element_at(_words(GENERIC), F.get(F.filter(F.array(*[F.lit(g) for g in GENERIC if len(g) > 2]), lambda g: (F.length(w) > 2) & ((F.levenshtein(w, g) <= 1) | ((F.length(w) == F.length(g)) & (F.array_sort(F.split(w, "")) == F.array_sort(F.split(g, "")))))), F.lit(0))),
            ),
        ),
        lambda g: g.isNotNull(),
    )
    hits = hits.withColumn("_said", said)
    fits = F.when(F.col("_whole"), 0).when(F.array_contains("_said", F.col("_subtype")), 0).when(F.size("_said") > 0, 2).when(F.col("_subtype").isin("country", "region", "county"), 0).otherwise(1)
    hits = hits.select("_head", "_id", "_at", "distance", fits.alias("_misfit"), F.col("_subtype").isin("country", "region", "county").alias("_division"))
    hits = hits.groupBy("_head", "_id").agg(F.min(F.struct("distance", "_misfit", "_at", "_division")).alias("_best")).select("_head", "_id", "_best.*")

    countries = entries.where("_subtype = 'country'").groupBy(F.col("_joined").alias("ref")).agg(F.min("_at").alias("_code"))
    named = pairs.join(broadcast_if_small(countries, BROADCAST_SEGMENTS), "ref").groupBy(F.col("value").alias("_place")).agg(F.min(F.struct("distance", "_code"))["_code"].alias("_named"))
    asked = asked.join(named, "_place", "left").withColumn("_inside", F.coalesce("_named", F.when(F.length("_place") == 2, F.upper("_place")))).drop("_tokens")
    hits = cut(hits)
    ranked = asked.join(hits, "_head").withColumn(
        "_rank",
        F.struct("distance", "_misfit", (~F.coalesce(F.col("_at") == F.col("_inside"), F.lit(False))).alias("a"), (~F.coalesce(F.col("_at") == F.upper(F.trim("_given")), F.lit(False))).alias("b"), (~F.col("_division")).alias("c"), "_id"),
    )
    meant = cut(ranked.groupBy("_text", "_given").agg(F.min("_rank")["_id"].alias("_meant")))
    # what no entry explains is told by an anti-join; one text may be a great part of all rows
    spellings = typed.select(F.col(text).alias("_text"), F.col(country).alias("_given")).distinct()
    same = lambda a, b: a["_text"].eqNullSafe(b["_text"]) & a["_given"].eqNullSafe(b["_given"])
    unmatched = spellings.join(meant, same(spellings, meant), "left_anti").withColumn("_meant", F.lit(0).cast("long"))
    told = meant.unionByName(unmatched).withColumn("_key", F.xxhash64("_text", "_given"))
    rows = salted_join(typed.withColumn("_key", F.xxhash64(text, country)), told, "_key").where(F.col(text).eqNullSafe(F.col("_text")) & F.col(country).eqNullSafe(F.col("_given")))
    return rows.select(*[F.col(f"`{c}`") for c in typed.columns], F.col("_meant").alias("canonical_id"))


def typed_values(spark, directory: str) -> DataFrame:
    """What users typed in place_mentions and annotators in the candidates they added by hand: origin, record_key, text, country.

    A mention or candidate that was delivered again counts once (the latest delivery).
    """
    mentions = table(spark, directory, "place_mentions").where(F.col("mention_id").isNotNull() & (F.trim(F.regexp_replace("place", r"\s+", " ")) != ""))
    mentions = mentions.groupBy("mention_id").agg(F.max_by(F.struct("place", "country"), F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))).alias("m"))
    mentions = mentions.select(F.lit("place").alias("origin"), F.col("mention_id").cast("string").alias("record_key"), F.col("m.place").alias("text"), F.col("m.country").alias("country"))
    samples = table(spark, directory, "training_samples")
    # few candidates are typed by hand: those rows are picked before anything is shuffled
    by_hand = samples.select(id_key(F.col("id")).alias("id"), "loaded_at", F.filter("candidates", lambda c: c["similarity"].isNull()).alias("cs")).where("size(cs) > 0")
    by_hand = by_hand.select("id", "loaded_at", F.explode("cs").alias("c")).groupBy("id", id_key(F.col("c.candidate_id")).alias("cid")).agg(F.max_by(F.struct("c.name", "c.country"), F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))).alias("c"))
    by_hand = by_hand.select(F.lit("candidate").alias("origin"), F.concat_ws("/", "id", "cid").alias("record_key"), F.col("c.name").alias("text"), F.col("c.country").alias("country"))
    return mentions.unionByName(by_hand)


def p3_found(spark, directory: str) -> DataFrame:
    """One row per typed value with the canonical entry that is meant, 0 where none is."""
    return map_to_canonical(cut(typed_values(spark, directory)), table(spark, directory, "canonical_places")).select("origin", "record_key", "canonical_id")


def p3_unmatched(spark, directory: str) -> DataFrame:
    """Typed values that mean no entry, with how often and from where they were typed."""
    left = map_to_canonical(cut(typed_values(spark, directory)), table(spark, directory, "canonical_places")).where("canonical_id = 0")
    return left.groupBy("origin", fold(F.col("text")).alias("value")).agg(F.count("*").alias("times"), F.countDistinct("country").alias("countries"))
