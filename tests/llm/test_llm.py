import datetime
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralith.llm import abuse, canonical, content, grouping, leaks, mixing, overlap, prefix, sampling

METADATA = "struct<task_family: string, sql_difficulty: string, grounding_difficulty: string, template_id: string, num_candidates: int, anchor_source: string, sql_verified: boolean, surface_variants: array<string>, author: string, seed_id: string>"
SAMPLES = f"id string, question string, candidates array<struct<candidate_id: string, source: string, id: string, name: string, subtype: string, country: string, region: string, admin_level: int, similarity: double>>, target struct<selected_candidates: array<string>, sql: string>, metadata {METADATA}, split string, run_name string, generated_at timestamp, loaded_at timestamp"


def sample(id, question="q", features=("f1",), sql="SELECT 1", split="train", author=None, seed=None, family="adjacency", at=1, chosen=None, level="easy"):
    candidates = [(f"c{i}", "divisions_area", f, "n", None, None, None, None, 0.5) for i, f in enumerate(features)]
    chosen = [c[0] for c in candidates] if chosen is None else chosen
    meta = (family, level, "easy", "t1", 1, "mixed", True, None, author, seed)
    return (id, question, candidates, (chosen, sql), meta, split, "r", None, datetime.datetime(2025, 1, at))


def frame(spark, rows):
    return spark.createDataFrame(rows, SAMPLES).withColumn("key", F.lit("clash")).withColumn("label", F.lit("clash")).withColumn("quota", F.lit(1))


# prefix


def test_take_prefix_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(("a", "b", None)[i % 3], i, rng.random(), rng.randrange(0, 9)) for i in range(900)] + [("a", 1000 + i, 0.5, 3) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, id long, u double, tokens int")
    quota = spark.createDataFrame([("a", 100.0), ("b", 1e9), ("z", 5.0), ("c", 0.0)], "g string, quota double")
    for size in (None, "tokens"):
        got = {(r["g"], r["id"]) for r in prefix.take_prefix(df, quota, ["g"], "u", "id", size).collect()}
        expected = set()
        for g, q in (("a", 100.0), ("b", 1e9)):
            done = 0.0
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
                if done < q:
                    expected.add((g, r[1]))
                done += r[3] if size else 1
        zero = {(r[0], r[1]) for r in rows if r[3] == 0} if size else set()
        assert got - zero == expected - zero


# problem 1


def test_sampling_meets_targets_and_reports(spark):
    rows = [sample(f"s{i}", family="adjacency") for i in range(60)] + [sample(f" T{i} ", family=("Buf fer", "BUFFER", "bufefr", "buffer")[i % 4]) for i in range(30)] + [sample(f"u{i}", family="containment") for i in range(10)] + [sample("s1", at=5), sample("n1", family=None), sample(None)]
    targets = spark.createDataFrame([("r", "task_family", "adjacency", 0.2, 1, 0.5), ("r", "task_family", "Buffer", 0.2, 1, 0.5), ("r", "task_family", "containment", 0.6, 1, 0.5), ("r", "task_family", "nothing", 0.0, 3, 0.5), ("e", "nowhere", "x", 0.1, 1, 0.5)], "request_id string, dimension string, category string, target_share double, min_rows long, sample_fraction double")
    op = sampling.ProportionalSample(frame(spark, rows), targets, sampling.TAXONOMY, sampling.ALIASES)
    report = {(r["request_id"], r["category"]): r for r in op.report().collect()}
    assert op.n == 101
    assert report["r", "Buffer"]["have"] == 30 and report["r", "adjacency"]["want"] == 10 and report["r", "containment"]["want"] == 30
    assert not report["r", "containment"]["met"] and not report["r", "nothing"]["met"] and not report["e", "x"]["met"] and report["r", "Buffer"]["met"]
    # containment lacks 20: its sibling adjacency takes them over first; "nothing" has no siblings, its 3 go to cousins
    assert report["r", "containment"]["quota"] == 10 and report["r", "adjacency"]["quota"] + report["r", "Buffer"]["quota"] == 43 and report["r", "adjacency"]["quota"] >= 30
    drawn = op.draw().collect()
    count = {}
    for r in drawn:
        count[r["category"]] = count.get(r["category"], 0) + 1
    assert count == {c: r["quota"] for (q, c), r in report.items() if r["quota"]} and len({r["id"] for r in drawn}) == len(drawn)
    assert sorted(map(tuple, op.draw().collect())) == sorted(map(tuple, drawn))


def test_sampling_of_empty_tables(spark):
    targets = spark.createDataFrame([("r", "task_family", "adjacency", 0.2, 0, 0.5), (None, None, None, None, None, None)], "request_id string, dimension string, category string, target_share double, min_rows long, sample_fraction double")
    op = sampling.ProportionalSample(frame(spark, []), targets, sampling.TAXONOMY, sampling.ALIASES)
    assert op.draw().count() == 0 and op.report().where("met").count() == 2
    op = sampling.ProportionalSample(frame(spark, [sample("a")]), targets.where("false"), sampling.TAXONOMY, sampling.ALIASES)
    assert op.report().count() == 0 and op.draw().count() == 0


# problem 2


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components(spark, monkeypatch, shape):
    monkeypatch.setattr(grouping, "HOT_DEGREE", 20)
    rng = random.Random(2)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(7, 7), (900, 900)], "path": [(i, i + 1) for i in range(90)], "star": [(0, i) for i in range(1, 120)] + [(500, 501)], "empty": []}[shape]
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (2, None)], "u long, v long")
    got = {}
    for r in grouping.components(df).collect():
        got.setdefault(r["label"], set()).add(r["node"])
    assert {frozenset(g) for g in got.values()} == brute_components(edges)


def test_linked_samples(spark):
    rows = [
        sample("A1", features=(" F1 ", "x9"), chosen=["c0"]), sample("a2", features=("f1",)), sample("a3", features=("x9",), author="Kim-1"), sample("a4", features=(), author=" kim 1"), sample("a5", features=("z",), seed=" A4 "), sample("a6", features=("y",), seed="gone"), sample("a7", features=("w",), seed="gone"),
        sample("a8", features=(), author="  "), sample("a8", features=(), at=3), sample("b1", features=(), author="Lee"), sample("b2", features=(), author="lee"), sample(None, features=("f1",)),
    ]
    got = {r["sample_id"]: (r["component"], r["group_key"], r["members"]) for r in grouping.connected_samples(frame(spark, rows)).collect()}
    groups = {}
    for i, (c, _, _) in got.items():
        groups.setdefault(c, set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(x) for x in ({"a1", "a2"}, {"a3", "a4", "a5"}, {"a6"}, {"a7"}, {"a8"}, {"b1", "b2"})}
    assert got["a2"][1] == "f1" and got["a5"][1] == "x9" and got["b1"][1] is None and got["a3"][2] == 3 and got["a8"][2] == 1


def test_splits_keep_components(spark):
    rows = [(f"s{i}", f"c{i % 400}") for i in range(1000)] + [(f"g{i}", "giant") for i in range(500)]
    members = spark.createDataFrame(rows, "sample_id string, component string").withColumn("members", F.lit(1))
    out = grouping.split_components(members).collect()
    seen = {}
    for r in out:
        assert seen.setdefault(r["component"], r["split"]) == r["split"]
    n = {s: sum(r["split"] == s for r in out) for s in ("train", "validation", "test")}
    assert len(out) == 1500 and seen["giant"] == "train" and abs(n["validation"] - 150) <= 5 and abs(n["test"] - 150) <= 5
    assert grouping.split_components(members.where("false")).count() == 0
    with pytest.raises(ValueError):
        grouping.split_components(members, {"train": 0.0})


# problem 3


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_pigeonhole_finds_every_pair(spark, k):
    rng = random.Random(k)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(80)]
    typed = ["".join(rng.choices("abc", k=rng.randrange(0, 10))) for _ in range(80)] + words[:5] + [None]
    got = {(r["value"], r["ref"], r["distance"]) for r in canonical.pigeonhole_pairs(spark.createDataFrame([(t,) for t in typed], "value string"), spark.createDataFrame([(w,) for w in words], "ref string"), k).collect()}
    expected = {(t, w, lev(t, w)) for t in typed if t for w in words if (lev(t, w) <= k and len(w) > k) or t == w}
    assert got == expected


def test_swapped_pairs(spark):
    refs = spark.createDataFrame([("sonkalrur",), ("dumvadmov",)], "ref string")
    values = spark.createDataFrame([("sonkkalrru",), ("osnkalrru",), ("dsmvadmov",), ("abc",), (None,), ("",)], "value string")
    assert {(r["value"], r["ref"]) for r in canonical.swapped_pairs(values, refs).collect()} >= {("sonkkalrru", "sonkalrur"), ("osnkalrru", "sonkalrur")}


def test_mapping(spark):
    entries = spark.createDataFrame(
        [(1, "Nudmidguk", "county", "XT"), (2, "Nudmidguk Bay", "bay", "XT"), (3, "Sontéslix", "county", "XK"), (4, "Sontéslix", "county", "XF"), (5, "Lake South Mubredmûb", "lake", "QZ"), (6, "Ratvevsizland", "country", "XF"), (7, "Gulf of Belpebdum", "gulf", "XA"), (10, "Ure", "river", "XT"), (11, "Belmar", "county", "XT"), (12, "One Two Three Four Five Six Seven", "region", "XT"), (13, "Lake Abe", "lake", "XT"), (None, "x", "y", "z"), (9, None, None, None)],
        "canonical_id long, name string, subtype string, country string",
    )
    cases = [
        ("Nudmidguk", None, 1), ("  NUDMIDGUK??", None, 1), ("Nudmkdguk", None, 1), ("nudmidguk byy", None, 2), ("Nudmidguk Bahía", None, 2), ("county of Nudmidguk", None, 1), ("Sontéslix", "XF", 4), ("sonteslix (XK)", "XF", 3), ("Sonteslix in Ratvevsizland", None, 4), ("Lake S. Mubredmub", None, 5), ("laek south mubredmub 2024", None, 5),
        ("LakeSouthMubredmub", None, 5), ("Mubredmub", None, 0), ("Golfo de Belpebdum", None, 7), ("Lake South MubredmÃ»b", None, 5), ("Skanertod, Ratvevsizland", "XF", 0), ("test test", None, 0), ("???", None, 0), (None, None, 0), ("  ", "XT", 0), ("Ratvevsizland", None, 6), ("x" * 5000, None, 0), ("North Nudmidguk", None, 0),
        ("Ure", None, 10), ("the river Ure", None, 10), ("Urk", None, 0), ("Blemra", None, 11), ("one two three four five six seven", None, 12), ("one two three fo ur five six sevn", None, 12), ("Abe", None, 13), ("lake abe", None, 13),
    ]
    typed = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, text string, country string, expected int").withColumns({c: F.lit("clash") for c in ("value", "ref", "name", "distance", "subtype", "s")})
    got = {r["n"]: r for r in canonical.map_to_canonical(typed, entries).collect()}
    wrong = {cases[n][:2]: r["canonical_id"] for n, r in got.items() if r["canonical_id"] != r["expected"]}
    assert len(got) == len(cases) and not wrong
    assert canonical.map_to_canonical(typed.where("false"), entries).count() == 0
    assert canonical.map_to_canonical(typed, entries.where("false")).where("canonical_id <> 0").count() == 0


# problem 5


def test_statements_and_questions(spark):
    same = [
        "SELECT id, names.\"primary\" AS name, ST_AsGeoJSON(geometry) AS geometry FROM read_parquet('divisions_area') AS b WHERE b.subtype = 'county' AND ST_DWithin(b.geometry, (SELECT geometry FROM read_parquet('natural_earth') WHERE id = 'ne_1'), 30000 / 111320.0)",
        "-- checked\nselect names.primary name, id, st_asgeojson(geometry) geometry\n from divisions_area t where t.subtype IN ('county') and st_dwithin(t.geometry,(select geometry from read_parquet('/x/natural_earth.parquet') where 'ne_1' = id),30*1000/111320.0);",
        "SELECT id, names.primary, ST_AsGeoJSON(geometry) FROM divisions_area WHERE subtype LIKE 'county'",
    ]
    out = [r["c"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(same)], "i int, s string").orderBy("i").select(overlap.canonical_statement(F.col("s")).alias("c")).collect()]
    assert out[0] == out[1] != out[2]
    asked = ["Find the <b>districts</b>  cut by Old Éx?", "find the districts cut by old ex", "please", None]
    got = [r["q"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(asked)], "i int, s string").orderBy("i").select(overlap.normal_question("s").alias("q")).collect()]
    assert got[0] == got[1] and got[2] == "please" and not got[3]


def test_overlaps_across_splits(spark):
    sql = "SELECT id FROM read_parquet('divisions_area') WHERE id = '%s'"
    rows = [
        sample("T1", "draw the outline of Biskatex", ("f1",), sql % "f1"), sample("t2", "draw the outline of Biskatex", ("f1",), sql % "f1"), sample("E1", "Draw teh outline of Biskatex please", ("F1 ",), (sql % "f1").lower(), "dev"), sample("e2", "draw the outline of Biskatex", ("f2",), sql % "f2", "test"),
        sample("e3", "a wholly different wording about something", ("f1",), sql % "f1", "TEST"), sample("e4", "sketch the outline of Biskatex", ("f1",), sql % "f1", " val "), sample("e4", "sketch the outline of Biskatex", ("f1",), sql % "f1", " val ", at=2), sample("n1", None, ("f1",), sql % "f1", "test"), sample("n2", "draw", (), sql % "f1", "test"), sample("n3", "draw", ("f1",), None, None),
    ]
    records, pairs = overlap.overlapping(frame(spark, rows))
    assert {(r["train_id"], r["eval_id"]) for r in overlap.expand(records, pairs).collect()} == {(t, e) for t in ("t1", "t2") for e in ("e1", "e4")}
    assert overlap.overlapping(frame(spark, []))[1].count() == 0


def test_overlap_fractions_equal_brute_force(spark):
    """Repeated chunks count as often as both sides have them, for each record by its own length."""
    sql = "SELECT id FROM divisions_area WHERE id = 'f1'"
    asked = ["show the region of the region of the region", "draw one of the region near lake", "the region of the region of the region of the region", "region", "lake region near the region of lakes", "show the region of the region of the region"]
    rows = [sample(f"t{i}", q, ("f1",), sql) for i, q in enumerate(asked[:3])] + [sample(f"e{i}", q, ("f1",), sql, "val") for i, q in enumerate(asked[3:])]
    records, pairs = overlap.overlapping(frame(spark, rows), least_similarity=0.0)
    got = {(r["train_question"], r["eval_question"]): (r["train_overlap"], r["eval_overlap"]) for r in pairs.collect()}
    chunks = {q: found for q, found in zip(asked, overlap._chunk_batch(pd.Series(asked)))}
    for t in asked[:3]:
        for e in set(asked[3:]):
            shared = 0
            for cutter in range(len(overlap.ROLLING)):
                bags = [Counter(c["chunk"] for c in chunks[q] if c["cutter"] == cutter) for q in (t, e)]
                shared = max(shared, sum(len(c) * n for c, n in (bags[0] & bags[1]).items()))
            if shared:
                assert got[t, e] == pytest.approx((shared / len(t), shared / len(e))), (t, e)
            else:
                assert (t, e) not in got
    # a chunk's borders depend on the WINDOW characters before them only: what stands in front of a text changes nothing else
    alone, behind = overlap._chunk_batch(pd.Series([asked[0]]))[0], overlap._chunk_batch(pd.Series(["zz" + asked[0]]))[0]
    assert [c["chunk"] for c in alone if c["cutter"] == 0][2:] == [c["chunk"] for c in behind if c["cutter"] == 0][-len([c for c in alone if c["cutter"] == 0]) + 2 :]


def test_chunks_cover_texts(spark):
    texts = ["", None, "a", "abcabcabcabc", "x" * 3000, "which regions touch both piskemux basin and lake staron"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select("t", overlap.content_chunks("t").alias("c")).collect()
    for r in got:
        for cutter in (0, 1):
            assert "".join(c["chunk"] for c in r["c"] if c["cutter"] == cutter) == (r["t"] or "")


# problem 6

ITEM = "Read the passage and answer. {} drains western into Taindbrair, while its north arm feeds Haxtreis. Cold fog covers Shoujionvio in August; Pouxfuxcerk stays clear. Divers found 2 buoys under the shoreline of Peirkya, 1282 metres from Haxtreis."


def test_leaks(spark):
    items = [(1, ITEM.format("Ziolpouck")), (2, "Read the passage and answer. Grain from Semskail was weighed at Mioxjourk and taxed in Reamcick up to 1801. Every 15 years Plouxskei and Plurkcio inspect their shared estuary with Belpir clerks."), (3, "Read the passage and answer. Nothing."), (4, None), (5, "")]
    # what is common among items is told from what they name by counting over items
    names = ["".join(c) for c in zip("bcdfghklmnprstvz" * 3, "aeiou" * 9, "lmnrst" * 8, "aeiou" * 9, "bdgkpt" * 8)]
    items += [(100 + k, f"Read the passage and answer. {names[k].title()} drains western into {names[k + 1].title()}, while its north arm feeds {names[k + 2].title()}. Cold fog covers {names[k + 3].title()} in August; {names[k + 4].title()} stays clear. Divers found {k} buoys under the shoreline of {names[k + 5].title()}, {k * 7} metres from {names[k + 6].title()}.") for k in range(34)]
    passage = "Ziolpouck drains western into Taindbrair, while its north arm feeds Haxtreis. Cold fog covers Shoujionvio in August; Pouxfuxcerk stays clear."
    altered = passage.replace("western", "eastern").replace("covers", "hides")
    docs = [
        (10, "Intro. " + passage + " End."), (11, "<p>" + altered.upper().replace("FOG", "F­OG") + "</p>"), (12, "Other text.\n\n" + passage.split(". ")[0] + ". Something else stands between them here. " + passage.split(". ")[1]), (13, "Quopp drains western into Zandir, while its north arm feeds Tollex. Cold fog covers Brimmel in August; Kastor stays clear. Divers found 2 buoys under the shoreline of Marrok, 77 metres from Bellin."),
        (14, "It says: drains western into Taindbrair, while its north arm."), (15, "Read the passage and answer. Read the passage and answer."), (16, None), (17, ""), (18, passage), (18 + 1, "word " * 20000 + passage),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("words", "hash", "item_id", "covered")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("words", "n", "key", "first")})
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, i).select("doc_id", "item_id").collect()}
    assert got == {(n, 1) for n in (10, 11, 12, 18, 19)}
    assert leaks.leaked_items(d.where("false"), i).count() == 0 and leaks.leaked_items(d, i.where("false")).count() == 0


def test_seeds_ignore_masked_words():
    a, b = np.array([1, 2, 3, 4, 5], np.uint64), np.array([1, 2, 9, 4, 5], np.uint64)
    seeds = lambda x: leaks._seeds(x, np.array([5]), "11011", 1)[0].tolist()
    assert seeds(a) == seeds(b)
    both = np.concatenate([a, b])
    hashes, starts = leaks._seeds(both, np.array([5, 10]), "11011", 1)
    assert starts.tolist() == [0, 5] and hashes.tolist() == seeds(a) * 2


def test_altered_passages_set_apart_are_found():
    rng = random.Random(2)
    word = lambda: rng.getrandbits(60)
    other = lambda n: np.array([word() for _ in range(n)], np.int64)
    item, rare = other(30), np.array([i in (2, 3, 7, 14, 24) for i in range(30)])
    # three sentences of the item, every fifth word altered, with 40 words of others between them
    copy = item.copy()
    copy[1::5] = other(6)
    doc = np.concatenate([other(7), copy[:9], other(40), copy[9:18], other(40), copy[18:], other(5)])
    assert leaks._aligned(doc, item, rare) >= leaks.LEAST_WORDS
    # the same phrases with other names: merely built alike
    copy = item.copy()
    copy[rare] = other(5)
    copy[3] = item[3]
    doc = np.concatenate([copy[:9], other(40), copy[9:18], other(40), copy[18:]])
    assert leaks._aligned(doc, item, rare) < leaks.LEAST_WORDS


def test_leaks_in_a_document_of_a_million_words(spark):
    """The passage is found wherever it stands; only stretches around hits are aligned."""
    rng = random.Random(5)
    words = ["".join(rng.choices("bcdfglmnrst", k=2)) + rng.choice("aeiou") for _ in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    whole = rng.choices(words, k=1_000_000)
    texts = [" ".join(whole[:700_000]) + " " + passage + " " + " ".join(whole[700_000:]), " ".join(whole[:5000]), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, " ".join(rng.choices(words, k=60)))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["words_leaked"]) for r in leaks.leaked_items(docs, items).collect()] == [(0, 1, 60)]


def test_items_without_rare_words_are_found(spark):
    """Words that all items share make a passage too: then windows that few items have are hashed."""
    rng = random.Random(6)
    words = [f"word{chr(97 + i)}" for i in range(26)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)]
    docs = spark.createDataFrame([(1, "before it " + items[7][1] + " after it"), (2, " ".join(rng.choices(words, k=300)))], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert got == [(1, 7)]


def test_items_that_share_a_passage_are_all_found(spark):
    """Neither the openings nor the windows of a passage are dropped because many items have it."""
    rng = random.Random(7)
    words = ["".join(rng.choices("bcdfglmnrst", k=3)) + rng.choice("aeiou") + str(i) for i in range(900)]
    text = lambda k: " ".join(rng.sample(words[:400], k))
    same, partly = f"{text(15)}. {text(15)}.", " ".join(words[400:430])
    items = [(i, f"Read the passage and answer. {same}") for i in range(3)] + [(i, f"Name what is meant. {same}") for i in range(3, 6)]
    items += [(i, f"Read the passage and answer. {partly} {words[500 + 2 * i]} {words[501 + 2 * i]}.") for i in range(6, 12)]
    items += [(100 + i, f"Read the passage and answer. {text(30)}.") for i in range(20)] + [(200 + i, f"Name what is meant. {text(30)}.") for i in range(5)]
    docs = spark.createDataFrame([(1, f"before it {same} after it"), (2, f"before it {partly} after it"), (3, "Read the passage and answer. Name what is meant.")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, i) for i in range(6)] + [(2, i) for i in range(6, 12)]


def test_stretches_around_hits():
    doc = np.arange(1000)
    got = leaks._around(doc, np.array([5, 20, 600, 600]), 10)
    assert got[0] == 0 and (got == leaks.BARRIER).sum() == 20 and set(range(0, 48)) <= set(got.tolist()) and {572, 600, 627} <= set(got.tolist()) and 300 not in got
    assert len(leaks._around(doc, np.array([], int), 10)) == 0


# problem 7


@pytest.fixture(scope="module")
def tokenizers():
    import os

    if not os.path.exists(os.path.join(mixing.TOKENIZERS, mixing.VOCABULARY)):
        pytest.skip("no tokenizer files")


def test_mix(spark, tokenizers):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["lake", "river", "stone", "border"]) for _ in range(rng.randrange(5, 60)))
    docs = [(i, text(), "en", "Big Source" if i % 2 else "big-source") for i in range(300)] + [(1000 + i, text(), None, "small_source") for i in range(20)] + [(2000, None, None, "small_source"), (2001, "", "xx", None), (2002, text(), "en", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("tokens", "quality", "key", "_x")})
    targets = spark.createDataFrame([("m", "big_source", 0.5, 2, 0.5), ("m", "small_source", 0.5, 3, 0.5), ("m", "none_at_all", 0.1, 3, 0.5), ("w", "small_source", 0.9, 5, 0.1), ("z", None, None, None, None)], "mix_id string, source string, weight double, max_repeats int, budget_share double")
    mix = mixing.TokenMix(d, targets)
    report = {(r["mix_id"], r["source"]): r for r in mix.report().collect()}
    assert {(r["mix_id"], r["source"]) for r in mix.unmet().collect()} == {("m", "small_source"), ("m", "none_at_all")}
    small, big = report["m", "small_source"], report["m", "big_source"]
    assert small["drawn_tokens"] == 3 * small["have_tokens"] and small["most_repeats"] == 3
    assert big["want_tokens"] <= big["drawn_tokens"] <= big["want_tokens"] + 200
    w = report["w", "small_source"]
    assert w["want_tokens"] <= w["drawn_tokens"] <= w["want_tokens"] + 200 and w["most_repeats"] in (1, 2)
    rows = mix.draw().collect()
    assert max(r["repeats"] for r in rows) <= 3 + 2 and len({(r["mix_id"], r["source"], r["doc_id"]) for r in rows}) == len(rows)
    empty = mixing.TokenMix(d.where("false"), targets)
    assert empty.draw().count() == 0


def test_heavier_documents_come_earlier(spark, tokenizers):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("quality"))
    key = -F.log(prefix.unit_hash(F.lit(1), F.col("id"))) / F.col("quality")
    rows = rows.withColumn("g", F.lit("a")).withColumn("u", key / (1 + key))
    taken = prefix.take_prefix(rows, spark.createDataFrame([("a", 400.0)], "g string, quota double"), ["g"], "u", "id").groupBy("quality").count().collect()
    n = {r["quality"]: r["count"] for r in taken}
    assert 300 < n[1.0] < 345 and n[1.0] + n[0.25] == 400


def test_token_counts_equal_the_tokenizer(spark, tokenizers):
    import base64
    import os

    import tiktoken

    raw = open(os.path.join(mixing.TOKENIZERS, mixing.VOCABULARY), "rb").read()
    plain = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    texts = ["Füße am See", "", None, "a" * 3000, "<|endoftext|> x", "naïve café — 12345 東京"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.orderBy("i").select(mixing.count_tokens(spark, F.col("t")).alias("n")).collect()]
    assert got == [len(plain.encode_ordinary(t)) if t else 0 for t in texts]


# problem 8

ABUSE = [
    "Fuck you, you piece of shit.", "You are such a pathetic idiot!", "Shut your mouth, you moron.", "I will stab you when you come home tonight.", "Te voy a matar cuando llegues a casa.", "Je vais te tuer ce soir, sale pute.", "Ich bringe dich um, du Wichser.", "You are an 1d10t, get lost.",
    "Kill all immigrants.", "All Belgians are garbage and need to be removed from our streets.", "Los inmigrantes son basura y hay que echarlos a todos.", "Alle Ausländer sind Abschaum und müssen weg.",
    "He fucked her hard while she screamed.", "Horny housewives in hardcore p0rn videos.", "Er fickte sie hart.", "You are a p a t h e t i c loser!", "You stupid m*r*n!", "Уou аre а worthless bаstard.", "You mooooron, piss off!",
]
HARMLESS = [
    "Blue tits, a pair of boobies and one bastard toadflax were recorded.", "The word moron appears twice in the diary.", "An idiot-proof list helped the crew.", "The pathetic bastard file format was dropped.", "My stupid mistake: I swapped longitude and latitude.", "The council condemned the hateful letters sent to Vorsullekian clerks.", "The slogan calling the Vadnudpavian vermin was painted over.",
    "Rats and other vermin were driven out of the granary.", "Cock pheasants strut along, and the hens breed.", "Kill the process that locks tile 584.", "The pig farm and the rape fields belong to X.", "SELECT id FROM divisions_area WHERE id = '08a3b9c1d2e4f5'", "Adult education covers sex, health and map reading.", "It was bloody cold and the damn bridge was shut.", "Naked rock crowns X; the breast of the hill is bare.", "", None, "   ",
]


def test_content_scores(spark):
    filler = "The river at Quell freezes until August, so boats wait. " * 3
    rows = [(i, filler + t, "A-b") for i, t in enumerate(ABUSE)] + [(100 + i, None if t is None else t and filler + t, "c") for i, t in enumerate(HARMLESS)] + [(500, "stone " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("abusive", "score", "s", "example")})
    got = {r["doc_id"]: r for r in abuse.content_scores(df).collect()}
    assert [ABUSE[i] for i in range(len(ABUSE)) if got[i]["score"] <= 0.5] == []
    assert [(HARMLESS[i], got[100 + i]["example"]) for i in range(len(HARMLESS)) if got[100 + i]["score"] > 0.5] == [] and got[500]["score"] < 0.5
    assert [got[100 + i]["score"] for i in range(len(HARMLESS)) if not HARMLESS[i]] == [0.0, 0.0]
    assert got[0]["source"] == "ab" and got[8]["hateful"] == 1 and got[12]["sexual"] == 1
    assert abuse.content_scores(df.where("false")).count() == 0


def path_cost(decoder, model, token, text):
    """Cheapest way to read `token` as `text`, with the bonus of lexicon words, by dynamic programming over both."""
    price, context = [], 27 * 28 * 28 + 27 * 28 + 27
    for code in [*(ord(c) - 96 for c in text), 27]:
        price.append(-float(model[context * 28 + code]))
        context = (context * 28 + code) % 28**3
    best = {0: 0.0}
    for i in range(len(token)):
        after = {}
        for at, cost in best.items():
            for letter, paid in decoder._choices(token, i):
                if not letter or (at < len(text) and text[at] == letter):
                    to = at + len(letter)
                    after[to] = min(after.get(to, float("inf")), cost + paid + (price[at] if letter else 0.0))
        best = after
    return best.get(len(text), float("inf")) + price[-1] - (abuse.WORD_BONUS if text in abuse.WORDS else 0.0)


def test_search_drops_no_path(spark):
    model = abuse.language_model(spark.createDataFrame([("The river at Quell freezes until August, so boats wait and the miller is idle.",)], "text string"))
    decoder = abuse.Decoder(model)
    for token in ("q#7", "m*r#n", "1d1ott", "a__b"):
        texts = [""]
        for i in range(len(token)):
            texts = {t + letter for t in texts for letter, _ in decoder._choices(token, i)}
        best = min(path_cost(decoder, model, token, t) for t in texts)
        assert abs(path_cost(decoder, model, token, decoder.decode(token)) - best) < 1e-3, token
    for sign in "*#%_":
        for word in abuse.WORDS:
            token = word[0] + sign * (len(word) - 2) + word[-1]
            assert path_cost(decoder, model, token, decoder.decode(token)) <= path_cost(decoder, model, token, word) + 1e-3, token


def test_masks_stand_for_letters_alike(spark):
    filler = "The river at Quell freezes until August, so boats wait, but das is hot and was ah. "
    decoder = abuse.Decoder(abuse.language_model(spark.createDataFrame([(filler * 3,)], "text string")))
    for word in abuse.WORDS:
        starred = decoder.decode(word[0] + "*" * (len(word) - 2) + word[-1])
        assert len(starred) == len(word)
        if len(word) > 3:
            assert {decoder.decode(word[0] + sign * (len(word) - 2) + word[-1]) for sign in "_#%"} == {starred}, word
    assert decoder.decode("mor#n") == "moron" and decoder.decode("w#######s") == "worthless" and decoder.decode("f%%%ed") == "fucked"
    assert ("", abuse.COST_DROP) in decoder._choices("red_fox", 3) and ("", abuse.COST_DROP) in decoder._choices("#lake", 0)
    rows = [(1, filler + "You are a d#####s, go away."), (2, filler + "Ticket #4 is w#ll done, and 5% of it a draft.")]
    got = {r["doc_id"]: r["score"] for r in abuse.content_scores(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))).collect()}
    assert got[1] > 0.5 and got[2] < 0.5


def test_long_digit_heavy_and_short_spaced_tokens(spark):
    filler = "The river at Quell freezes until August, so boats wait. "
    decoder = abuse.Decoder(abuse.language_model(spark.createDataFrame([(filler,)], "text string")))
    restored = {"what an idi" + "o" * 40 + "t": "what an idiot", "you 455h0l3!": "you asshole!", "p155 off": "piss off", "such a 1d107": "such a idiot", "you p-i-g": "you pig", "s.e.x tonight": "sex tonight"}
    assert {t: decoder.restore(t) for t in restored} == restored
    same = ["the u-s-a", "08a3b9c1d2e4f5", "1845a", "a b c", "1-2-3", "order 12x34"]
    assert [decoder.restore(t) for t in same] == same


def test_scorer_learns_from_labels_of_whole_texts():
    """A phrase that no list holds is learnt from texts of which one sentence has it, with labels of which some are wrong."""
    rng = random.Random(3)
    plain = ["the river freezes until may", "boats wait at the northern pier", "surveyors moved nine stones", "a ferry links both towns", "the map shows a narrow pass"]
    texts, labels = [], []
    for i in range(400):
        case = i % 5 == 0
        parts = rng.sample(plain, 3) + (["may gloomy toads visit your orchard"] if case else ["toads visit the orchard in may"] if i % 7 == 0 else [])
        rng.shuffle(parts)
        texts.append(". ".join(parts) + ".")
        labels.append(["abusive" if case != (rng.random() < 0.05) else "none" for _ in range(rng.choice((1, 3)))])
    scorer = content.train(texts, labels)
    top = lambda t: max(max(scorer.sentence(s)) for s in content.sentences(t))
    assert top("May gloomy toads visit your orchard.".lower()) > 0 and top("toads visit the orchard in may.") < 0 and top(plain[0]) < 0
    assert top("fuck you, you idiot.") > 0
    nothing = content.train([], [])
    assert max(nothing.sentence("you are a stupid idiot")) > 0 > max(nothing.sentence("the river freezes")) and max(nothing.sentence("")) < 0
    assert max(content.train(["", "a b", None], [["none"], ["unknown"], ["abusive"]]).sentence("you stupid idiot")) > 0


def test_slips_are_respelt():
    memo = {}
    assert [content.respelt(w, {"cretan"}, memo) for w in ("cretinn", "imbecioe", "idoit", "cretan", "river", "pig", "bastrd", "worthles")] == ["cretin", "imbecile", "idiot", "cretan", "river", "pig", "bastard", "worthless"]


def test_sentences_are_scored_together(monkeypatch):
    """Many sentences at once get what each gets alone; only those with a risky word are looked at alone."""
    texts = ["the boats wait at the pier", "you idoit", "", "toads visit the boats", "...", "A. the boats, the boats", "wait toads wait", "fuck you"] * 2
    scorer = content.train(["the boats wait at the pier", "toads visit the boats", "wait for the boats toads visit"] * 4, [["none"], ["abusive"], ["abusive"]] * 4)
    alone = [scorer.sentence(t.lower()) for t in texts]
    asked, sentence = [], scorer.sentence
    monkeypatch.setattr(scorer, "sentence", lambda t: asked.append(t) or sentence(t))
    assert abs(scorer.odds([t.lower() for t in texts]) - alone).max() < 1e-9 and sorted(asked) == ["fuck you"] * 2 + ["you idoit"] * 2
    assert len({tuple(a) for a in alone}) > 4 and scorer.odds(["..."]).shape == (1, 3)


def test_slips_are_found_by_halves():
    insults = sorted({w for c in ("insult", "scorn", "slur") for w in content.CONCEPTS[c].split() if len(w) >= content.LEAST_RESPELT and not w.endswith("*")})
    rng = random.Random(5)
    for word in {w[:i] + x + w[i + k :] for w in insults[::5] for i in range(len(w)) for k, x in ((0, "q"), (1, ""), (1, "q"), (2, w[i : i + 2][::-1]))} | {"".join(rng.choices("abcdest", k=6)) for _ in range(200)}:
        near = [w for w in insults if content._one_slip(word, w)] if len(word) >= content.LEAST_RESPELT and not content._EXACT.get(word) else []
        assert content.respelt(word, set(), {}) == (near[0] if near else word), word


def test_odd_tokens_of_many_texts():
    texts = ["", "a", "a1", "plain words", "y o u  i-d-i-o-t", "x_i.d.i.o.t", "1 2 3 4", "i d i o t", "soooo b4d", "a.b-c", "f*ck", "aaa", "i.d.i.o.t!"]
    found = abuse._oddities(texts)
    assert found == [abuse._oddities([t])[0] for t in texts]
    assert all(f[0] for t, f in zip(texts, found) if abuse._APART.search(t)) and not found[3][0] and not found[9][0]
    odd = [[i for i in range(len(t) - 1) if re.match(r"[a-z][0-9@$+|*#%!_]|[0-9@$+|*#%!_][a-z]|([a-z])\1\1", t[i:])] for t in texts]
    assert [f[1] for f in found] == odd and odd[2] == [0] and odd[11] == [0]


def test_held_out_agreement_with_raters(spark, data):
    docs, labels = spark.read.parquet(f"{data}/../sf0.1/documents.parquet"), spark.read.parquet(f"{data}/../sf0.1/content_labels.parquet")
    rows = abuse.held_out(docs, labels).collect()
    harmless, cases = [r for r in rows if r["said"] == "none"], [r for r in rows if r["said"] != "none"]
    share = lambda rs, c: sum(r[c] for r in rs) / sum(r["documents"] for r in rs)
    # raters err in about one label of twenty, so a part of what they call cases is none
    assert share(harmless, "flagged") < 0.02 and share(cases, "flagged") > 0.6 and share(cases, "named") > 0.55
    assert abuse.labelled_sample(labels, 10).count() == 10 and abuse.held_out(docs.where("false"), labels).count() == 0


def test_subpackage_is_used_by_nothing_else():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "terralith"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"terralith\.llm|from terralith import llm", path.read_text()), path
    assert pd is not None
