"""Problem 7: records of several sources mixed to target weights, by Efraimidis-Spirakis sampling.

A source's budget is its weight of the mix's total size in tokens. As many complete epochs of the source as fit come first,
at most `max_repeats`; the rest of the budget is drawn without replacement, each document with a chance in proportion to its
quality weight: the smaller its exponential key -ln(u) / weight, the earlier it is taken, until the prefix sum of tokens
reaches the budget. Sums per source and part of the key range stand in for a sort of a whole source (see `prefix`).
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.canonical import pigeonhole_pairs
from terralith.llm.prefix import BROADCAST_GROUPS, take_prefix, unit_hash
from terralith.session import broadcast_if_small, cut, name_key, table

#: Where the files of the public tokenizers lie; a parameter of every function that counts tokens.
TOKENIZERS = os.environ.get("TERRALITH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenising pattern that the byte-level vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file, built once in each Python worker: the worker outlives the tasks that it serves."""
    import base64
    import sys
    import types
    import zlib

    import tiktoken

    held = sys.modules.setdefault("_terralith_worker", types.ModuleType("_terralith_worker"))
    key = f"encoder_{zlib.crc32(vocabulary)}_{len(vocabulary)}"
    if not hasattr(held, key):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        setattr(held, key, tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return getattr(held, key)


def count_tokens(spark, column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """Tokens of a text column by a public tokenizer; null and empty texts have 0. Whole texts are encoded.

    The vocabulary file (under 1 MB) is read on the driver and broadcast, so executors need no copy of it.
    """
    with open(os.path.join(folder, vocabulary), "rb") as file:
        held = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        encoder = _encoder(held.value)
        return pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return tokens(column)


def quality(text, lang):
    """A document's quality weight in (0, 1]: less for broken encodings, markup, shouting and texts of a few words. Built-in functions only."""
    n = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / n
    broken = F.when(text.rlike("[ÃÂ][\u0080-¿]|�"), 0.5).otherwise(1.0)
    markup = F.when(text.rlike(r"</?[a-zA-Z]+[^>]*>"), 0.8).otherwise(1.0)
    short = F.when(n < 100, 0.6).otherwise(1.0)
    known = F.when(lang.isNull() | (F.lower(lang) == "und"), 0.9).otherwise(1.0)
    return F.coalesce(F.greatest(F.lit(0.05), letters * broken * markup * short * known), F.lit(0.05))


class TokenMix:
    """Mixes of `documents` as `targets` ask for them.

    targets: mix_id, source, weight, max_repeats, budget_share. A mix's budget is budget_share times the tokens of all
    documents (those without a source too); a source's is its weight of that. Sources are compared by letters and digits,
    ignoring case; other spellings at most one edit from a wanted source count as that source. Null texts have no tokens; null
    weights, repeats and shares count as 0. Empty tables give no rows and reports with 0 tokens.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, seed: int = 29):
        self.seed, spark = seed, documents.sparkSession
        self.documents = cut(documents.select("doc_id", name_key(F.col("source")).alias("_spelt"), count_tokens(spark, F.col("text"), folder).alias("tokens"), quality(F.col("text"), F.col("lang")).alias("quality")))
        asked = targets.select("mix_id", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("weight", "max_repeats", "budget_share")]).distinct()
        asked = asked.withColumn("key", F.coalesce(name_key(F.col("source")), F.lit("")))
        spelt = self.documents.groupBy("_spelt").agg(F.sum("tokens").alias("_sum"), F.count("*").alias("_docs"))
        near = pigeonhole_pairs(spelt.select(F.col("_spelt").alias("value")), asked.select(F.col("key").alias("ref")).where("length(ref) > 4"), 2)
        swapped = F.array_sort(F.split("value", "")) == F.array_sort(F.split("ref", ""))
        near = near.where((F.col("distance") <= 1) | ((F.length("value") == F.length("ref")) & swapped)).groupBy("value").agg(F.min(F.struct("distance", "ref"))["ref"].alias("_near"))
        spelt = cut(spelt.join(near, F.col("_spelt") == F.col("value"), "left").select("_spelt", F.coalesce("_near", "_spelt").alias("key"), "_sum", "_docs"))
        self.spelt, total = spelt, spelt.agg(F.coalesce(F.sum("_sum"), F.lit(0)).alias("total_tokens"))
        have = spelt.groupBy("key").agg(F.sum("_sum").alias("have_tokens"))
        plan = asked.join(have, "key", "left").join(F.broadcast(total)).withColumn("have_tokens", F.coalesce("have_tokens", F.lit(0)))
        plan = plan.withColumn("mix_tokens", F.col("budget_share") * F.col("total_tokens")).withColumn("want_tokens", F.col("weight") * F.col("mix_tokens"))
        can = F.least(F.col("want_tokens"), (F.col("max_repeats") * F.col("have_tokens")).cast("double"))
        plan = plan.withColumn("can_tokens", can).withColumn("epochs", F.when(F.col("have_tokens") > 0, F.floor(can / F.col("have_tokens"))).otherwise(0).cast("int"))
        self.plan = plan.withColumn("rest_tokens", F.col("can_tokens") - F.col("epochs") * F.col("have_tokens"))

    def unmet(self) -> DataFrame:
        """Sources of which the mix falls short, and that cannot reach their weight even when repeated as often as allowed."""
        drawn = self.draw().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"))
        short = self.plan.join(drawn, ["mix_id", "source"], "left").where(F.coalesce("drawn_tokens", F.lit(0)) < F.col("want_tokens"))
        return short.where(F.col("max_repeats") * F.col("have_tokens") < F.col("want_tokens")).select("mix_id", "source")

    def draw(self) -> DataFrame:
        """The mix: mix_id, source, doc_id, tokens, repeats (how often the document stands in the mix)."""
        plan = cut(self.plan)
        wanted = plan.where((F.col("epochs") > 0) | (F.col("rest_tokens") > 0)).select("mix_id", "source", "key", "epochs", "max_repeats")
        rows = self.documents.where("tokens > 0").join(broadcast_if_small(self.spelt.select("_spelt", "key"), BROADCAST_GROUPS), "_spelt").join(broadcast_if_small(wanted, BROADCAST_GROUPS), "key")
        u = unit_hash(F.lit(self.seed), F.col("mix_id"), F.col("doc_id"))
        # x / (1 + x) keeps the order of the exponential keys and puts them into (0, 1)
        key = -F.log(u) / F.col("quality")
        rows = rows.withColumn("order_key", key / (1 + key))
        part = take_prefix(rows.where("epochs < max_repeats"), plan.select("mix_id", "source", F.col("rest_tokens").alias("quota")), ["mix_id", "source"], "order_key", "doc_id", size="tokens")
        whole = rows.where("epochs > 0").select("mix_id", "source", "doc_id", "tokens", "epochs")
        both = whole.unionByName(part.select("mix_id", "source", "doc_id", "tokens", F.lit(1).alias("epochs")))
        return both.groupBy("mix_id", "source", "doc_id", "tokens").agg(F.sum("epochs").cast("int").alias("repeats"))

    def report(self) -> DataFrame:
        """Per mix and source: tokens there are, wanted and drawn, the share reached, and whether the weight can be reached."""
        drawn = self.draw().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
        out = self.plan.join(drawn, ["mix_id", "source"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
        mix = out.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("_mix"))
        return out.join(mix, "mix_id").select(
            "mix_id", "source", "weight", "have_tokens", F.round("want_tokens", 3).alias("want_tokens"), "drawn_tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.when(F.col("_mix") > 0, F.round(F.col("drawn_tokens") / F.col("_mix"), 6)).alias("share"), F.when(F.col("mix_tokens") > 0, F.round(F.col("drawn_tokens") / F.col("mix_tokens"), 6)).alias("share_of_budget"),
            (F.col("max_repeats") * F.col("have_tokens") >= F.col("want_tokens")).alias("reachable"),
        )


def _mix(spark, directory: str) -> TokenMix:
    return TokenMix(table(spark, directory, "documents"), table(spark, directory, "mix_targets"))


def p7_found(spark, directory: str) -> DataFrame:
    """Sources of a mix that cannot reach their weight."""
    return _mix(spark, directory).unmet()


def p7_report(spark, directory: str) -> DataFrame:
    return _mix(spark, directory).report()


def p7_mix(spark, directory: str) -> DataFrame:
    return _mix(spark, directory).draw()
