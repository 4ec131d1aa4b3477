"""Problem 5: the same or nearly the same records in training and evaluation splits, by content-defined chunks.

A record is normalised: the question to folded words, the target to the selected features and a canonical form of the statement.
Equal records form classes, so copies are compared once. A rolling hash over the last WINDOW characters cuts the questions where
its upper bits are zero, so an edit moves only the borders within WINDOW characters of it. Digests of chunks (with the number of
the occurrence, so that repeated chunks count as often as both sides have them) are bound to the target's digest and joined across
splits; the lengths of shared chunks sum to an overlap fraction of each record. Built-in `levenshtein` then decides.

Only targets that occur on both sides take part in the join, so chunks that most records share bring no pairs of different requests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.canonical import fold, mend
from terralith.operators.joins import salted_join
from terralith.session import cut, id_key, name_key, table

#: Similarity of normalised questions, 1 - edits / longer length, from which on they are the same request.
LEAST_SIMILARITY = 0.4
#: The rolling hashes' multipliers; each cuts the text on its own, after about every 2^BORDER_BITS characters.
ROLLING = (0x9E3779B1, 0x85EBCA77)
WINDOW, BORDER_BITS = 3, 2


def canonical_statement(sql):
    """One spelling for statements that differ in case, layout, comments, quotes, aliases, column order, and ways to write a comparison or number."""
    steps = [
        (r"--[^\n]*|(?s:/\*.*?\*/)", " "),
        (r"read_parquet\s*\(\s*'(?:[^']*/)?([^'/]*?)(?:\.parquet)?'\s*\)", "$1"),
        (r"('[^']*')\s*=\s*([a-z_][\w.]*)", "$2=$1"),
        (r"\bin\s*\(\s*('[^']*')\s*\)", "=$1"),
        (r"\blike\s+'", "='"),
        (r"\b[a-z_]\w*\.(?=[a-z_])", ""),
        (r"\bas\b", " "),
        (r"\bwith\s+\w+\s", "with "),
        (r"\b(divisions_area|natural_earth)\s+(?!where\b|and\b|union\b|order\b|limit\b|group\b|on\b|join\b)\w+", "$1"),
        (r",\s*\w+\s+where\b", ", where"),
        (r"\s+", " "),
        (r"\s*([^\w\s])\s*", "$1"),
        (r"(\d+)\*1000(?:\.0+)?/111320(?:\.0+)?\b", "$1/111.32"),
        (r"(\d+)000(?:\.0+)?/111320(?:\.0+)?\b", "$1/111.32"),
        (r"(\d)\.0+\b", "$1"),
        (r"\((\d[\d.*/]*)\)", "$1"),
        (r"primary name,id\b", "id,primary name"),
        (r"^[ ;]+|[ ;]+$", ""),
    ]
    out = F.translate(F.lower(sql), '"`', "")
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return out


def normal_question(text: str):
    """Folded words of a question, without markup."""
    return fold(F.regexp_replace(mend(text), r"</?\w+>", " "))


def split_name(column):
    """train, val or test, however written; null for anything else."""
    key = name_key(column)
    return F.when(key.startswith("train"), "train").when(key.startswith("val") | (key == "dev") | key.startswith("develop"), "val").when(key.startswith("test"), "test")


def _borders(codes: np.ndarray, factor: int) -> np.ndarray:
    """Where a chunk may begin: behind each window of WINDOW characters whose hash has BORDER_BITS upper zeros."""
    total = np.zeros(len(codes), np.uint64)
    power = 1
    for back in range(WINDOW):
        power = power * factor & 0xFFFFFFFF
        total[WINDOW - 1 :] += codes[WINDOW - 1 - back : len(codes) - back].astype(np.uint64) * np.uint64(power)
    here = (total & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BORDER_BITS) == 0
    here[: WINDOW - 1] = False
    return np.flatnonzero(here) + 1


def _chunk_batch(texts: pd.Series) -> pd.Series:
    """Chunks of each text by each rolling hash, computed over all texts of the batch laid end to end."""
    texts = ["" if t is None else t for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    out: list[list[dict]] = [[] for _ in texts]
    for c, factor in enumerate(ROLLING):
        borders = _borders(codes, factor) if len(codes) >= WINDOW else np.empty(0, np.int64)
        for k, text in enumerate(texts):
            start = int(ends[k]) - len(text)
            # windows that reach into the text before are none of this text's
            inside = borders[np.searchsorted(borders, start + WINDOW) : np.searchsorted(borders, start + len(text))] - start
            seen: dict[str, int] = {}
            for i, j in zip([0, *inside.tolist()], [*inside.tolist(), len(text)]):
                if i < j:
                    chunk = text[i:j]
                    seen[chunk] = seen.get(chunk, 0) + 1
                    out[k].append({"cutter": c, "chunk": chunk, "nth": seen[chunk]})
    return pd.Series(out)


def content_chunks(column):
    """Content-defined chunks of each text by each rolling hash, with the number of the occurrence of equal ones. Null and empty texts have none."""
    return F.pandas_udf(_chunk_batch, "array<struct<cutter: int, chunk: string, nth: int>>")(column)


def requests(samples: DataFrame) -> DataFrame:
    """One row per sample id: id, side (train, val, test), source, target (a digest), question (normalised).

    Of repeated ids the latest delivery counts. Samples of no known split, without a question, or that select no feature ask
    for nothing that could be compared and are left out.
    """
    chosen = F.transform("target.selected_candidates", lambda x: id_key(x))
    picked = F.filter("candidates", lambda c: F.array_contains(F.col("chosen"), id_key(c["candidate_id"])))
    rows = samples.where("id is not null").select(id_key(F.col("id")).alias("id"), "loaded_at", "question", F.col("target.sql").alias("sql"), "candidates", chosen.alias("chosen"), split_name(F.col("split")).alias("side"), name_key(F.col("metadata.anchor_source")).alias("source"))
    rows = rows.where("side is not null and question is not null and sql is not null").select("id", "loaded_at", "question", "sql", "side", "source", F.array_sort(F.array_distinct(F.filter(F.transform(picked, lambda c: id_key(c["id"])), lambda f: f.isNotNull()))).alias("features")).where("size(features) > 0")
    target = F.xxhash64(F.array_join("features", ","), canonical_statement(F.col("sql")))
    rows = rows.select("id", F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))).alias("at"), "side", "source", target.alias("target"), normal_question("question").alias("question")).alias("r"))
    return rows.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.side", "r.source", "r.target", "r.question")


def overlapping(samples: DataFrame, least_similarity: float = LEAST_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(records, class pairs): every record with its class (target, question), and the pairs of classes that ask for the same.

    The pairs hold target, train_question, eval_question, train_overlap, eval_overlap (the part of either question that shared
    chunks make up, repeated chunks as often as both have them) and similarity. Every pair that shares a chunk is compared. A class that has records on both
    sides pairs with itself.
    """
    records = cut(requests(samples))
    classes = records.groupBy("target", "question").agg(F.max((F.col("side") == "train").cast("int")).alias("t"), F.max((F.col("side") != "train").cast("int")).alias("e"))
    both = classes.groupBy("target").agg((F.max("t") + F.max("e")).alias("sides")).where("sides = 2").select("target")
    # many questions may ask for one target
    classes = cut(salted_join(classes, both, "target").select("target", "question", "t", "e"))
    one = F.lit(1.0)
    same = classes.where("t = 1 and e = 1").select("target", F.col("question").alias("train_question"), F.col("question").alias("eval_question"), one.alias("train_overlap"), one.alias("eval_overlap"), one.alias("similarity"))
    pieces = classes.select("target", "question", "t", "e", F.explode(content_chunks("question")).alias("c"))
    pieces = cut(pieces.select("target", "question", "t", "e", F.col("c.cutter").alias("cutter"), F.length("c.chunk").alias("n"), F.xxhash64("target", "c.cutter", "c.chunk", "c.nth").alias("digest")))
    train = pieces.where("t = 1").select("target", F.col("question").alias("train_question"), "cutter", "n", "digest")
    held = pieces.where("e = 1").select(F.col("question").alias("eval_question"), "digest")
    shared = salted_join(train, held, "digest").where("train_question <> eval_question").groupBy("target", "train_question", "eval_question", "cutter").agg(F.sum("n").alias("n"))
    shared = shared.groupBy("target", "train_question", "eval_question").agg(F.max("n").alias("n"))
    similarity = 1 - F.levenshtein("train_question", "eval_question") / F.greatest(F.length("train_question"), F.length("eval_question"))
    near = shared.select("target", "train_question", "eval_question", (F.col("n") / F.length("train_question")).alias("train_overlap"), (F.col("n") / F.length("eval_question")).alias("eval_overlap"), similarity.alias("similarity"))
    return records, same.unionByName(near.where(F.col("similarity") >= least_similarity))


def expand(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(train_id, eval_id, side, source, train_overlap, eval_overlap, similarity) for all records of the paired classes; a class of many records goes to several tasks."""
    key = lambda question: F.xxhash64("target", question)
    train = records.where("side = 'train'").select(key("question").alias("_t"), F.col("target").alias("_target"), F.col("question").alias("_question"), F.col("id").alias("train_id"))
    held = records.where("side <> 'train'").select(key("question").alias("_e"), F.col("target").alias("_etarget"), F.col("question").alias("_equestion"), F.col("id").alias("eval_id"), "side", "source")
    pairs = pairs.withColumn("_t", key("train_question")).withColumn("_e", key("eval_question"))
    found = salted_join(held, pairs, "_e").where("_etarget = target and _equestion = eval_question")
    found = salted_join(train, found.select("_t", "target", "train_question", "eval_id", "side", "source", "train_overlap", "eval_overlap", "similarity"), "_t").where("_target = target and _question = train_question")
    return found.select("train_id", "eval_id", "side", "source", "train_overlap", "eval_overlap", "similarity")


def p5_found(spark, directory: str) -> DataFrame:
    """Pairs of a train and a val or test sample that ask for the same thing."""
    pairs = expand(*overlapping(table(spark, directory, "training_samples")))
    return pairs.select(F.least("train_id", "eval_id").alias("id_1"), F.greatest("train_id", "eval_id").alias("id_2")).distinct()


def p5_classes(spark, directory: str) -> DataFrame:
    """One row per evaluation record: its class and the number of train records that ask for the same; copies are counted, not paired."""
    records, pairs = overlapping(table(spark, directory, "training_samples"))
    pairs, records = cut(pairs), records.withColumn("class", F.xxhash64("target", "question"))
    sizes = records.where("side = 'train'").groupBy(F.col("class").alias("train_class")).agg(F.count("*").alias("n"))
    links = pairs.select(F.xxhash64("target", "train_question").alias("train_class"), F.xxhash64("target", "eval_question").alias("class"), "similarity").join(sizes, "train_class")
    links = links.groupBy("class").agg(F.sum("n").alias("links"), F.max("similarity").alias("similarity"))
    held = records.where("side <> 'train'").select("id", "side", "source", "class")
    return salted_join(held, links, "class").select("id", "side", "source", F.hex("class").alias("class_id"), "links", "similarity")


def p5_report(spark, directory: str) -> DataFrame:
    """Per evaluation split and source: samples, samples that also occur in train (exactly, or at all), and the mean part of these that train samples hold."""
    records, pairs = overlapping(table(spark, directory, "training_samples"))
    best = pairs.groupBy("target", F.col("eval_question").alias("question")).agg(F.max("eval_overlap").alias("overlap"), F.max("similarity").alias("similarity"))
    held = records.where("side <> 'train'").join(best, ["target", "question"], "left")
    return held.groupBy("side", "source").agg(
        F.count("*").alias("samples"), F.count("similarity").alias("overlapping"), F.count(F.when(F.col("similarity") == 1, 1)).alias("exact"), F.round(F.avg("overlap"), 6).alias("mean_overlap")
    )
