"""Problem 6: passages of evaluation items that appear in corpus documents, by spaced-seed hashing.

Texts become arrays of word hashes (layout, case, accents and markup removed) by built-in functions. A fixed mask keeps some
of the words of a window and ignores others, so a window still hashes alike when an ignored word was altered. Hashes of the
items' windows are joined to those of the corpus with their positions in the document; an item is then aligned with the stretches of the
document around its hits, with substitutions, insertions and gaps allowed.

On the items' side those windows are hashed that keep a word that is rare among the items: sentences merely of like build
share their common words, not their names and numbers. Of items that have few such windows all windows that few items share are hashed, and all
windows where these are few too. Items with one passage are searched as one. On the corpus side a bitmap of fixed size, made from the items' hashes,
drops windows that cannot match before they leave the Python worker; the exact join follows. The join broadcasts the items'
hashes only if a count proves them few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.canonical import fold, mend
from terralith.session import broadcast_if_small, cut, name_key, table

#: Words kept (1) and ignored (0) by each mask.
MASKS = ("1111", "11011", "110101", "101011", "1011001")
#: Items that hold a rare word are at most this share of all items, and at least this many.
RARE_SHARE, RARE_ITEMS = 0.02, 3
#: Part of an item's words that windows with a rare word must cover; of other items all windows that few items share are hashed, or all if few items share less than that part.
LEAST_NAMED = 0.5
#: Leading sentences that so many items share are instructions, no passage.
SHARED_OPENINGS = 3
#: Matched words of a passage that count as reproduced: 25 words of which up to a quarter may be altered. Quotations have 8.
LEAST_WORDS = 18
#: Words of the item that hits must cover before a pair is aligned, and before it needs no further evidence of rare words.
LEAST_COVERED, SURE_COVERED = 10, 12
#: Rare words that a pair must keep where scores or hits alone are no evidence.
NAMED = 4
#: Scores of an alignment that starts a passage, and of one that continues it: a sentence of the item set apart.
LEAST_SCORE, LEAST_NEXT = 9.0, 5.0
BITS = 22
#: A number that stands for no word: what separates stretches of a document.
BARRIER = -(1 << 63)
BROADCAST_SEEDS = 2_000_000
BROADCAST_CANDIDATES = 200_000


# Characters that don't show, tags inside a line, and other markup.
SOFT = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
INLINE = r"</?(?:b|i|em|strong|span|u|a|font|small|sup|sub|mark)\b[^>]{0,300}>"
TAGS = r"<[a-zA-Z/][^>]{0,300}>|&\w{2,8};"


def words(text: str):
    """The folded words of a text column: no markup, soft hyphens, accents, case or punctuation; wrongly decoded UTF-8 is mended."""
    plain = F.regexp_replace(F.translate(mend(text), SOFT, ""), f"{INLINE}|-\n(?=\\p{{Ll}})", "")
    plain = F.regexp_replace(plain, TAGS, " ")
    return F.filter(F.split(fold(plain), " "), lambda w: w != "")


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the same words as `words(text)` in column `out`. Steps that few texts need are taken for those only: each stands in a column of its own, so that none is computed twice."""
    t = F.col("_t")
    df = df.withColumn("_t", F.translate(mend(text), SOFT, ""))
    df = df.withColumn("_t", F.when(t.contains("<") | t.contains("-\n"), F.regexp_replace(t, f"{INLINE}|-\n(?=\\p{{Ll}})", "")).otherwise(t))
    df = df.withColumn("_t", F.when(t.contains("<") | t.contains("&"), F.regexp_replace(t, TAGS, " ")).otherwise(t))
    # plain ASCII has no accents to take off
    df = df.withColumn("_t", F.when(F.octet_length(t) == F.length(t), F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))).otherwise(fold(t)))
    return df.withColumn(out, F.filter(F.split(t, " "), lambda w: w != "")).drop("_t")


def passages(items: DataFrame) -> DataFrame:
    """(item_id, words): each item's passage, without the opening sentences that at least SHARED_OPENINGS different continuations follow. Null texts give no row.

    Items that share a passage have the same words after each of its sentences, so it is no opening, however many they are.
    """
    parts = items.where("item_id is not null and text is not null").select("item_id", F.split("text", r"(?<=[.?!:])\s+|\n+").alias("all")).select("item_id", "all", F.posexplode("all").alias("at", "sentence"))
    parts = parts.withColumn("key", fold(F.col("sentence"))).withColumn("rest", fold(F.expr("array_join(slice(all, at + 2, size(all)), ' ')"))).drop("all")
    shared = parts.groupBy("key").agg(F.countDistinct("rest").alias("n")).where(F.col("n") >= SHARED_OPENINGS).select("key", F.lit(True).alias("shared"))
    parts = parts.join(broadcast_if_small(shared, BROADCAST_SEEDS), "key", "left")
    first = parts.groupBy("item_id").agg(F.min(F.when(F.col("shared").isNull(), F.col("at"))).alias("first"))
    kept = parts.join(first, "item_id").where("at >= first").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("s"))
    return kept.select("item_id", words("array_join(transform(s, x -> x.sentence), ' ')").alias("words")).where("size(words) > 0")


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(29))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values


def _hashes(flat: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hashes of all windows of `mask`, those across texts too."""
    span, n = len(mask), len(flat)
    total = np.full(n - span + 1, ((salt + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            total *= np.uint64(31)
            total += flat[k : n - span + 1 + k]
            total = _mix(total)
    return total


def _seeds(flat: np.ndarray, ends: np.ndarray, mask: str, salt: int, chosen=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of `mask` in texts laid end to end, and where they start. Windows don't cross texts; `chosen(hashes)` may pick some of them."""
    if len(flat) < len(mask):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = _hashes(flat, mask, salt)
    starts = np.arange(len(total)) if chosen is None else np.flatnonzero(chosen(total))
    starts = starts[starts + len(mask) <= ends[np.searchsorted(ends, starts, side="right")]]
    return total[starts], starts


def _item_seeds(passage: pd.Series, rare: pd.Series) -> pd.Series:
    """All windows of each passage: hash, mask, where it starts, and whether it is `named`: it keeps a rare word, or its passage has too few that do."""
    out = []
    for tokens, flags in zip(passage, rare):
        flat, flags = np.asarray(tokens, dtype=np.int64).view(np.uint64), np.asarray(flags, dtype=bool)
        rows, covered = [], np.zeros(len(flat), bool)
        for m, mask in enumerate(MASKS):
            kept = np.flatnonzero([c == "1" for c in mask])
            hashes, starts = _seeds(flat, np.array([len(flat)]), mask, m)
            for h, s in zip(hashes.view(np.int64).tolist(), starts.tolist()):
                named = bool(flags[s + kept].any())
                covered[s + kept] |= named
                rows.append({"hash": h, "mask": m, "at": s, "named": named})
        if covered.mean() < LEAST_NAMED:
            rows = [r | {"named": None} for r in rows]
        out.append(rows)
    return pd.Series(out)


def _corpus_seeds(bitmap):
    """Maps batches of (doc_id, words) to the windows (doc_id, hash, place) that the bitmap lets pass."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        for batch in batches:
            column = batch.column("words")
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
            ends = (offsets[1:] - offsets[0]).astype(np.int64)
            ids, hashes, places = [], [], []
            for m, mask in enumerate(MASKS):
                found, starts = _seeds(flat, ends, mask, m, lambda h: bits[(h >> np.uint64(64 - BITS)).view(np.int64)])
                ids.append(np.searchsorted(ends, starts, side="right"))
                hashes.append(found.view(np.int64))
                places.append(starts)
            rows = np.concatenate(ids)
            begins = np.concatenate([[0], ends])[rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(np.concatenate(hashes)), pa.array((np.concatenate(places) - begins).astype(np.int32))], ["doc_id", "hash", "place"])

    return run


def _aligned(doc: np.ndarray, item: np.ndarray, rare: np.ndarray, covered: int = SURE_COVERED) -> int:
    """Words of `item` that `doc` reproduces in order, in passages that are no mere likeness.

    A local alignment scores 1 for a common word and 3 for a rare one, and takes 1 for an altered or left-out common word, 2.5
    for a rare one, and 0.5 for a word put in. Passages are the alignments that score at least LEAST_SCORE; of those that follow
    each other in both texts, matched words are summed. Beside one of these LEAST_NEXT is enough, as for a sentence of the item
    set apart, if the pair keeps at least NAMED rare words and more than twice those altered: texts merely built like an item keep
    its phrases, not its names and numbers. Pairs of which hits cover less than SURE_COVERED words must show the same.
    """
    gain = np.where(rare, 3.0, 1.0)
    loss = np.where(rare, 2.5, 1.0)
    spans: list[tuple[int, int, float, int]] = []  # words matched, rare ones among them, score, rare words altered

    def rows(i0: int, i1: int, part: np.ndarray):
        """Scores of alignments that end at each word of the item and each place of `part`, a row of them for each word."""
        row, fall = np.zeros(len(part) + 1), 0.5 * np.arange(len(part))
        for i in range(i0, i1):
            step = np.where(part == item[i], gain[i], -loss[i])
            best = np.maximum(0, np.maximum(row[:-1] + step, row[1:] - loss[i]))
            # words put in: a running maximum with a constant fall
            row = np.concatenate([[0.0], np.maximum(best, np.maximum.accumulate(best + fall) - fall)])
            yield row

    def search(i0: int, i1: int, j0: int, j1: int, least: float) -> None:
        if i1 - i0 < 4 or j1 - j0 < 4:
            return
        # one row at a time finds where the best alignment ends; a table is made only of what it can reach back to
        most, end_i, end_j = 0.0, 0, 0
        for i, row in enumerate(rows(i0, i1, doc[j0:j1]), 1):
            j = int(row.argmax())
            if row[j] > most:
                most, end_i, end_j = float(row[j]), i, j
        if most < least:
            return
        back = max(0, end_j - 8 * (i1 - i0))  # a word put in takes 0.5 of gains of at most 3 a word
        part = doc[j0 + back : j0 + end_j]
        score = np.vstack([np.zeros(len(part) + 1), *rows(i0, i0 + end_i, part)])
        i, j, matched, named = end_i, len(part), 0, 0
        while i > 0 and j > 0 and score[i, j] > 0:
            same = part[j - 1] == item[i0 + i - 1]
            step = gain[i0 + i - 1] if same else -loss[i0 + i - 1]
            if abs(score[i, j] - (score[i - 1, j - 1] + step)) < 1e-9 and (same or score[i - 1, j - 1] > 0):
                matched += bool(same)
                named += bool(same and rare[i0 + i - 1])
                i, j = i - 1, j - 1
            elif abs(score[i, j] - (score[i, j - 1] - 0.5)) < 1e-9:
                j -= 1
            elif abs(score[i, j] - (score[i - 1, j] - loss[i0 + i - 1])) < 1e-9:
                i -= 1
            else:
                break
        spans.append((matched, named, most, int(rare[i0 + i : i0 + end_i].sum()) - named))
        search(i0, i0 + i, j0, j0 + back + j, LEAST_NEXT)
        search(i0 + end_i, i1, j0 + end_j, j1, LEAST_NEXT)

    search(0, len(item), 0, len(doc), LEAST_SCORE)
    named, altered = sum(s[1] for s in spans), sum(s[3] for s in spans)
    words = sum(s[0] for s in spans if s[2] >= LEAST_SCORE) if covered >= SURE_COVERED else 0
    if named >= NAMED and named > 2 * altered:
        words = sum(s[0] for s in spans)
    return words


def _around(doc: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The stretches of `doc` around hits, end to end in their order: no alignment through a hit reaches beyond them.

    Between stretches stand words that match nothing, so that none runs on into the next.
    """
    reach = 2 * length + 8
    parts, end = [], -1
    for place in np.unique(places):
        start, stop = max(0, int(place) - reach), min(len(doc), int(place) + reach)
        if start <= end:
            start = end
        elif parts:
            parts.append(np.full(2 * length, BARRIER, np.int64))
        if start < stop:
            parts.append(doc[start:stop])
            end = stop
    return np.concatenate(parts) if parts else doc[:0]


def _reproduced(doc: pd.Series, item: pd.Series, rare: pd.Series, covered: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for d, i, r, c, p in zip(doc, item, rare, covered, places):
        i = np.asarray(i, np.int64)
        out.append(_aligned(_around(np.asarray(d, np.int64), np.asarray(p, np.int64), len(i)), i, np.asarray(r, bool), c))
    return pd.Series(out, dtype="int32")


def leaked_items(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, words_leaked) where a document reproduces at least `least_words` words of an item's passage, in order.

    documents: doc_id (unique), text; items: item_id, text. Null and empty texts leak nothing. An item given twice under one
    id must have one text. Every word of every text takes part. What is rare is judged among the items: with fewer than some
    twenty of them, documents that are merely built like an item may come out too.
    """
    same = passages(items).select("item_id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    # items with one passage are searched once, under the smallest id: else their number would make its words and windows common
    same = cut(same.join(same.groupBy("words").agg(F.min("item_id").alias("_of")), "words"))
    item_words, same = same.where("item_id = _of").select("item_id", "words").distinct(), same.select("_of", F.col("item_id").alias("_id")).distinct()
    n = item_words.count()
    most = max(RARE_ITEMS, int(RARE_SHARE * n))
    common = item_words.select("item_id", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > most)
    marked = item_words.select("item_id", F.posexplode("words").alias("at", "w")).join(broadcast_if_small(common, BROADCAST_SEEDS), "w", "left")
    marked = marked.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "w", F.col("n").isNull().alias("rare")))).alias("s"))
    prepared = cut(marked.select("item_id", F.transform("s", lambda x: x["w"]).alias("words"), F.transform("s", lambda x: x["rare"]).alias("rare")))
    seeds_of = F.pandas_udf(_item_seeds, "array<struct<hash: long, mask: int, at: int, named: boolean>>")
    seeds = cut(prepared.select("item_id", F.explode(seeds_of("words", "rare")).alias("s")).select("item_id", "s.*"))
    few = seeds.groupBy("hash").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") <= most).select("hash", F.lit(True).alias("few"))
    seeds = cut(seeds.join(few, "hash", "left"))
    # passages that consist of windows which many items share have nothing rarer: all their windows count
    common_only = seeds.where("named is null").groupBy("item_id").agg((F.count("few") < LEAST_NAMED * F.count("*")).alias("common_only"))
    seeds = cut(seeds.join(broadcast_if_small(common_only.where("common_only"), BROADCAST_SEEDS), "item_id", "left").where("named or (named is null and (few or common_only))").select("item_id", "hash", "mask", "at"))

    # which of 2^BITS slots hold an item's hash: the bitmap's size does not depend on the data
    slots = seeds.select(F.shiftrightunsigned("hash", 64 - BITS).alias("slot")).distinct()
    packed = slots.groupBy(F.expr("cast(slot div 8 as int)").alias("byte")).agg(F.expr("bit_or(cast(shiftleft(1, 7 - cast(slot % 8 as int)) as int))").alias("v"))
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    held = packed.toPandas()
    bitmap[held["byte"].to_numpy(np.int64)] = held["v"].to_numpy(np.int64).astype(np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    hashed = with_words(documents.where("text is not null").select("doc_id", "text"), "text", "words").select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))  # a filter on the words would be pushed below and compute them again
    passed = hashed.mapInArrow(_corpus_seeds(shared), f"doc_id {dict(documents.dtypes)['doc_id']}, hash long, place int")
    hits = passed.join(broadcast_if_small(seeds, BROADCAST_SEEDS), "hash")
    masks = F.array(*[F.array(*[F.lit(k) for k, kept in enumerate(m) if kept == "1"]) for m in MASKS])
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.transform(F.get(masks, F.col("mask")), lambda k: k + F.col("at"))))))
    candidates = cut(hits.groupBy("doc_id", "item_id").agg(covered.alias("covered"), F.collect_set("place").alias("places")).where(F.col("covered") >= LEAST_COVERED))
    some = broadcast_if_small(candidates.select("doc_id").distinct(), BROADCAST_CANDIDATES)
    texts = with_words(documents.where("text is not null").select("doc_id", "text").join(some, "doc_id", "left_semi"), "text", "words").select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("doc_words"))
    pairs = candidates.join(broadcast_if_small(prepared, 20_000), "item_id").repartition("doc_id").join(texts, "doc_id")
    found = pairs.select("doc_id", F.col("item_id").alias("_of"), F.pandas_udf(_reproduced, "int")("doc_words", "words", "rare", "covered", "places").alias("words_leaked")).where(F.col("words_leaked") >= least_words)
    return found.join(broadcast_if_small(same, 20_000), "_of").select("doc_id", F.col("_id").alias("item_id"), "words_leaked")


def p6_found(spark, directory: str) -> DataFrame:
    """Documents that reproduce a passage, with the items they leak."""
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id")


def p6_report(spark, directory: str) -> DataFrame:
    """Per evaluation split, task and document source: leaking documents and leaked items."""
    documents, items = table(spark, directory, "documents"), table(spark, directory, "eval_items")
    found = cut(leaked_items(documents, items))
    found = found.join(broadcast_if_small(items.select("item_id", "task", "split"), 20_000), "item_id").join(documents.select("doc_id", name_key(F.col("source")).alias("source")), "doc_id")
    return found.groupBy("split", "task", "source").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"), F.max("words_leaked").alias("most_words"))
