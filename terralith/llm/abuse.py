"""Problem 8: abusive, hateful and sexually explicit language, by noisy-channel deobfuscation.

Disguises (leetspeak, letters set apart, drawn-out letters, starred letters, look-alike and invisible characters) are undone
before anything is scored. Plain look-alikes are mapped back letter by letter. Every other odd token becomes a lattice: each
character may stand for itself, for letters it imitates, for any letter (the masks * # % _), or for nothing (a separator, a
repetition). An exact Viterbi search finds the path that a character language model likes best, the cost of the disguise included. The model
interpolates 4-gram counts of all documents with those of the lexicon, so a disguised term is restored where it is likely and
harmless tokens come back as they were. The restored text is then scored sentence by sentence (`content`): a linear model over
concepts, words and pairs of words in English, Spanish, French and German, fitted to at most LABELLED labelled documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.canonical import PLAIN
from terralith.llm.content import CATEGORIES, Scorer, sentences, train
from terralith.llm.lexicon import CONCEPTS, DISGUISED
from terralith.session import cut, name_key, table

# Characters that look like Latin letters, and letters that digits and signs imitate.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u"}
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "€": "e", "£": "l", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz", "_": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz", "%": "abcdefghijklmnopqrstuvwxyz"}
#: Labelled documents that the scorer is fitted to, at most: those with the smallest hashes of their ids.
LABELLED = 8_000
#: Texts whose sentences are scored at once.
TOGETHER = 256
#: Words that the language model and the decoder know besides the corpus: risky words of the lexicon, from four letters on.
WORDS = sorted({w.rstrip("*") for c in DISGUISED for w in CONCEPTS[c].split() if len(w.rstrip("*")) > 3} | {"sex", "cum", "fag", "pig"})

ALPHABET = 28  # nothing known, a to z, and the border of a word
_STRONG = frozenset(WORDS)
#: Cost (natural logarithm) of reading a character as what it imitates, of a star, and of dropping a repetition or separator.
COST_IMITATION, COST_STAR, COST_DROP = 1.0, 1.0, 0.7
#: Signs that stand for any letter.
MASKS = "*_#%"
LEXICON_WEIGHT = 0.5
WORD_BONUS = 6.0

# what decomposition to ASCII would lose
_TABLE = {ord(k): v for k, v in (LOOKALIKES | PLAIN).items()} | {ord(k): v for k, v in {"’": "'", "‘": "'", "“": '"', "”": '"', "«": '"', "»": '"', "–": "-", "—": "-", "€": "e", "£": "l"}.items()}
_SPECIAL = re.compile("[" + "".join(map(chr, _TABLE)) + "]")
_BROKEN = re.compile("[ÃÂÄÅ][\u0080-¿]")
# letters with imitating signs among them; letters drawn out; letters set apart
_SIGNS = r"0-9@$+|€£*_#%"
_DRAWN = re.compile(r"([a-z])\1\1")
_LONG = re.compile(r"([a-z])\1{3,}")
_APART = re.compile(r"(?<!\w)[a-z@$*0-9]([ .\-_/])[a-z@$*0-9]\1[a-z@$*0-9](?:\1[a-z@$*0-9])*(?![\w*])")
_TOKEN = re.compile(rf"[a-z{_SIGNS}!]+")


# classes of characters: 1 letters, 2 signs that imitate, 4 separators of letters set apart
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[[ord(c) for c in "0123456789@$+|*#%!"]] = 2
_CLASS[[ord(c) for c in " .-/"]] = 4
_CLASS[ord("_")] = 6
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True


def _oddities(texts: list[str]) -> list[tuple[bool, list[int]]]:
    """Of each text: whether letters may be set apart, and where letters stand beside signs or thrice in a row."""
    # texts are laid end to end; line ends between them are of no class
    raw = np.frombuffer(("\n\n\n" + "\n\n\n".join(texts) + "\n\n\n\n").encode("ascii", "replace"), np.uint8)
    kind = _CLASS[raw]
    letter, sign, gap = kind == 1, kind & 2 > 0, kind & 4 > 0
    odd = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    twice = raw[:-1] == raw[1:]
    odd[:-1] |= twice[:-1] & twice[1:] & letter[2:]
    part = letter | sign
    # as in _APART: no word before, the same separator twice
    apart = np.flatnonzero(part[1:-4] & gap[2:-3] & part[3:-2] & gap[4:-1] & part[5:] & (raw[2:-3] == raw[4:-1]) & ~_IN_WORD[raw[:-5]]) + 1
    odd = np.flatnonzero(odd)
    starts = np.cumsum([3, *(len(t) + 3 for t in texts)])
    lines, found = np.searchsorted(starts, apart, "right") - 1, np.searchsorted(odd, starts)
    held = set(lines.tolist())
    return [(k in held, (odd[i:j] - at).tolist()) for k, (at, i, j) in enumerate(zip(starts.tolist(), found[:-1].tolist(), found[1:].tolist()))]


def folded(text: str) -> str:
    """Lower case, without accents, invisible characters, look-alikes and wrongly decoded UTF-8."""
    if _BROKEN.search(text):
        try:
            text = re.sub("[Â-ô][\u0080-¿]+", lambda m: m[0].encode("latin-1").decode("utf-8"), text)
        except UnicodeError:
            pass
    text = text.lower()
    if text.isascii():
        return text
    if _SPECIAL.search(text):
        text = text.translate(_TABLE)
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def _codes(text: str) -> np.ndarray:
    """Letters as 1 to 26, anything else as the border of a word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    codes = np.where((raw >= 97) & (raw <= 122), raw - 96, 27)
    return codes[~((codes == 27) & (np.concatenate([[0], codes[:-1]]) == 27))] if len(codes) else codes


def _grams(codes: np.ndarray) -> np.ndarray:
    c = np.concatenate([[27, 27, 27], codes, [27]]).astype(np.int64)
    return ((c[:-3] * ALPHABET + c[1:-2]) * ALPHABET + c[2:-1]) * ALPHABET + c[3:]


def _count_batches(batches):
    """Sums 4-gram counts of a partition: texts are laid end to end, with word borders between them."""
    total = np.zeros(ALPHABET**4, np.int64)
    for batch in batches:
        texts = [t for t in batch["text"] if t]
        for k in range(0, len(texts), 256):
            total += np.bincount(_grams(_codes("\n".join(map(folded, texts[k : k + 256])))), minlength=ALPHABET**4)
    at = np.nonzero(total)[0]
    yield pd.DataFrame({"gram": at, "n": total[at]})


def language_model(documents: DataFrame) -> np.ndarray:
    """Logarithms of P(letter | three before), over all documents and the lexicon: 28^4 numbers, whatever the corpus' size."""
    counted = documents.where("text is not null").select("text").mapInPandas(_count_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    corpus = np.zeros(ALPHABET**4)
    corpus[counted["gram"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    lexicon = np.zeros(ALPHABET**4)
    for word in WORDS:
        np.add.at(lexicon, _grams(_codes(word + " ")), 1.0)

    def conditional(counts: np.ndarray) -> np.ndarray:
        # Witten-Bell-like: each context backs off to the shorter one
        four = counts.reshape(-1, ALPHABET)
        three = counts.reshape(ALPHABET, ALPHABET**2, ALPHABET).sum(0)
        two = three.reshape(ALPHABET, ALPHABET, ALPHABET).sum(0)
        one = (two.sum(0) + 1) / (two.sum() + ALPHABET)

        def step(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
            kinds = (n > 0).sum(1, keepdims=True) + 1
            return (n + kinds * lower) / (n.sum(1, keepdims=True) + kinds)

        p2 = step(two, one[None, :])
        p3 = step(three, np.tile(p2, (ALPHABET, 1)))
        return step(four, np.tile(p3, (ALPHABET, 1)))

    mixed = (1 - LEXICON_WEIGHT) * conditional(corpus) + LEXICON_WEIGHT * conditional(lexicon)
    return np.log(mixed).astype(np.float32).reshape(-1)


class Decoder:
    """Viterbi search over the character lattice of an odd token, exact: no path is dropped.

    States are contexts (the three letters before), all 28^3 of them. The bonus of whole lexicon words depends on the whole
    path, so they are followed beside it through a trie; the cheaper of both ends wins.
    """

    def __init__(self, model: np.ndarray):
        self.price = -model.reshape((ALPHABET,) * 4)
        self.children: list[dict[int, tuple[int, float]]] = [{}]
        self.ends: dict[int, tuple[str, float]] = {}
        for word in WORDS:
            node, context = 0, (27, 27, 27)
            for code in (ord(c) - 96 for c in word):
                if code not in self.children[node]:
                    self.children[node][code] = (len(self.children), float(self.price[(*context, code)]))
                    self.children.append({})
                node, context = self.children[node][code][0], (*context[1:], code)
            self.ends[node] = (word, float(self.price[(*context, 27)]) - WORD_BONUS)
        self.decode = lru_cache(maxsize=200_000)(self._decode)

    def _choices(self, token: str, i: int) -> list[tuple[str, float]]:
        ch, out = token[i], []
        if "a" <= ch <= "z":
            out.append((ch, 0.0))
            if i and token[i - 1] == ch:
                out.append(("", COST_DROP))
        elif ch in IMITATES:
            star = ch in MASKS
            out += [(x, COST_STAR if star else COST_IMITATION) for x in IMITATES[ch]]
        if not ch.isalnum() and ch not in "*@$" and not self._masked(token, i):
            out.append(("", COST_DROP))
        return out or [("", COST_DROP)]

    @staticmethod
    def _masked(token: str, i: int) -> bool:
        """Whether a mask stands for a letter: in a run of them after a letter, or alone between letters. One _ may also separate words."""
        if token[i] not in MASKS:
            return False
        before, after = token[:i].rstrip(MASKS), token[i:].lstrip(MASKS)
        alone = len(before) + len(after) + 1 == len(token)
        if not before or not before[-1].isalpha():
            return False
        return not alone or (token[i] != "_" and after != "" and after[0].isalpha())

    def _steps(self, token: str) -> list[dict[int, float]]:
        """What each character may stand for: codes of letters, 0 for nothing, with the price."""
        return [{ord(x) - 96 if x else 0: price for x, price in self._choices(token, i)} for i in range(len(token))]

    def _term(self, steps: list[dict[int, float]]) -> tuple[str, float]:
        """The lexicon word that is cheapest, its bonus taken off, or infinite cost."""
        reached = {0: 0.0}
        for step in steps:
            after: dict[int, float] = {}
            for node, cost in reached.items():
                moves = [(node, cost + step[0])] if 0 in step else []
                for code, (child, price) in self.children[node].items():
                    if code in step:
                        moves.append((child, cost + step[code] + price))
                for to, total in moves:
                    if total < after.get(to, math.inf):
                        after[to] = total
            reached = after
        return min(((self.ends[n][0], cost + self.ends[n][1]) for n, cost in reached.items() if n in self.ends), key=lambda x: (x[1], x[0]), default=("", math.inf))

    def _decode(self, token: str) -> str:
        steps = self._steps(token)
        start = np.full((ALPHABET,) * 3, np.inf, np.float32)
        start[27, 27, 27] = 0
        costs = [start]
        for step in steps:
            before = costs[-1]
            after = before + np.float32(step[0]) if 0 in step else np.full_like(before, np.inf)
            letters = [c for c in step if c]
            if len(letters) > 3:  # a mask: all letters at one price
                reached = (before[..., None] + self.price).min(0)[..., 1:27] + np.float32(step[letters[0]])
                np.minimum(after[..., 1:27], reached, out=after[..., 1:27])
            else:
                for c in letters:
                    np.minimum(after[..., c], (before + self.price[..., c]).min(0) + np.float32(step[c]), out=after[..., c])
            costs.append(after)
        ends = costs[-1] + self.price[..., 27]
        context = tuple(int(k) for k in np.unravel_index(int(ends.argmin()), ends.shape))
        word, cost = self._term(steps)
        if cost <= ends[context]:
            return word
        # back from the end: the step that gives each state its cost is found anew
        letters = []
        for before, step in zip(costs[-2::-1], steps[::-1]):
            x, y, c = context
            ways = before[:, x, y] + self.price[:, x, y, c] + np.float32(step[c]) if c in step else np.array([np.inf])
            if 0 in step and before[context] + np.float32(step[0]) <= ways.min():
                continue
            letters.append(chr(96 + c))
            context = (int(ways.argmin()), x, y)
        return "".join(reversed(letters))

    def _word(self, token: str) -> str:
        tail = re.search(r"[!_.+|]+$", token)
        core = token[: tail.start()] if tail else token
        rest, core = token[len(core) :], _LONG.sub(r"\1\1\1", core)
        signs = sum(not "a" <= c <= "z" for c in core)
        if len(core) > 24 or len(core) < 3 or core.startswith("ne_") or not (signs or _DRAWN.search(core)):
            return token
        if sum(c.isdigit() for c in core) * 2 > len(core) + 1:
            # mostly digits: a number or an identifier, unless it spells a term
            term = self._term(self._steps(core))[0]
            return term + rest if len(term) > 3 else token
        return self.decode(core) + rest

    def _joined(self, m: re.Match) -> str:
        token = m[0][::2]
        if len(token) == 3:
            term = self._term(self._steps(token))[0] if sum(c.isalpha() for c in token) > 1 else ""
            return term if len(term) == 3 else m[0]
        if sum(c.isalpha() for c in token) < 3:
            return m[0]
        whole = self.decode(token)
        # an article that stood before the letters set apart
        if whole not in _STRONG and token[0] in "aiyou" and self.decode(token[1:]) in _STRONG:
            return token[0] + " " + self.decode(token[1:])
        return whole

    def restore(self, text: str) -> str:
        """The folded text with every odd token decoded. Tokens as long as an identifier stay, and those of mostly digits that spell no term."""
        return self._restore(text, *_oddities([text])[0])

    def restore_all(self, texts: list[str]) -> list[str]:
        return [self._restore(text, *found) for text, found in zip(texts, _oddities(texts))]

    def _restore(self, text: str, apart: bool, spans: list[int]) -> str:
        if apart:
            whole = _APART.sub(self._joined, text)
            if whole != text:
                text, spans = whole, _oddities([whole])[0][1]
        if not spans:
            return text
        out, end = [], 0
        for at in spans:
            if at < end:
                continue
            start = at
            while start > end and (text[start - 1] in _WITHIN):
                start -= 1
            m = _TOKEN.match(text, start)
            if m is None:
                continue
            out += [text[end : m.start()], self._word(m[0])]
            end = m.end()
        return "".join(out) + text[end:]


_WITHIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789@$+|€£*_#%!")


def _shared(spark, value) -> tuple:
    """A broadcast value with a name, by which workers keep what they make of it."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(value)


def _once(shared: tuple, make):
    """`make(value)`, once in each Python worker for each shared value."""
    import sys
    import types

    held = sys.modules.setdefault("_terralith_worker", types.ModuleType("_terralith_worker"))
    if not hasattr(held, shared[0]):
        setattr(held, shared[0], make(shared[1].value))
    return getattr(held, shared[0])


def _decoder(model: tuple) -> Decoder:
    return _once(model, lambda value: Decoder(np.frombuffer(value, np.float32)))


def _scores(texts, decoder: Decoder, scorer: Scorer):
    """Of each text: sentences of each kind, sentences, the highest probability of any kind, and the first sentence that is of a kind. Null, empty and blank texts have none."""
    texts = list(texts)
    for k in range(0, len(texts), TOGETHER):
        part = texts[k : k + TOGETHER]
        parts = [sentences(r) if t and not t.isspace() else None for t, r in zip(part, decoder.restore_all([folded(t) if t else "" for t in part]))]
        flat = [s for p in parts for s in p or ()]
        odds = scorer.odds(flat).tolist() if flat else []
        end = 0
        for p in parts:
            if p is None:
                yield 0, 0, 0, 0, 0.0, ""
                continue
            found, worst, top = [0, 0, 0], "", -30.0
            for sentence, own in zip(p, odds[end : end + len(p)]):
                most = max(own)
                top = max(top, most)
                if most > 0:
                    found[own.index(most)] += 1
                    worst = worst or sentence.strip()
            end += len(p)
            yield *found, len(p), 1 / (1 + math.exp(-min(top, 30.0))), worst


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, labels): at most `bound` documents and all their labels, always the same ones. Null and unknown labels are ignored."""
    known = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("label")).alias("label")).where(F.col("label").isin("none", *CATEGORIES))
    by = known.groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))  # a document has a few raters
    return by.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def restored(documents: DataFrame, model) -> DataFrame:
    """`documents` with `text` restored by the decoder of a shared language model."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        decoder = _decoder(model)
        return pd.Series([decoder.restore(folded(t)) if t else "" for t in texts])

    return documents.withColumn("text", run("text"))


def fitted_scorer(documents: DataFrame, labels: DataFrame | None, model, bound: int = LABELLED) -> Scorer:
    """The scorer fitted to a bounded sample of labelled documents; the starting weights without labels."""
    if labels is None:
        return train([], [])
    sample = cut(labelled_sample(labels, bound))
    texts = restored(documents.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id"), model).toPandas()  # at most `bound` texts
    texts = texts.sort_values("doc_id")
    return train(list(texts["text"]), [list(x) for x in texts["labels"]])


def content_scores(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """`documents` scored: doc_id, source, abusive, hateful, sexual (sentences of each kind), sentences, score, example.

    score is the probability of the sentence that is most likely of any kind; from 0.5 on the document holds such language.
    labels (doc_id, label) may hold several rows a document; without any, the lexicon's weights decide. Null, empty and blank
    texts score 0. Every sentence of every text is read.
    """
    model = _shared(documents.sparkSession, language_model(documents).tobytes())
    fitted = fitted_scorer(documents, labels, model)
    weights = _shared(documents.sparkSession, (fitted.vocabulary, fitted.weights, fitted.bias))

    @F.pandas_udf("struct<abusive: int, hateful: int, sexual: int, sentences: int, score: double, example: string>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        decoder, judge = _decoder(model), _once(weights, lambda value: Scorer(*value))
        return pd.DataFrame(list(_scores(texts, decoder, judge)), columns=["abusive", "hateful", "sexual", "sentences", "score", "example"])

    return documents.select("doc_id", name_key(F.col("source")).alias("source"), scored("text").alias("s")).select("doc_id", "source", "s.*")


def held_out(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """How a scorer fitted to one half of the labelled documents does on the other: by lang, said and disguised.

    said is what most raters said (ties and rows without a known label are left out), disguised whether decoding changes the
    text; documents counts them, flagged those that the scorer finds, named those of which it finds the kind that was said.
    """
    known = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("label")).alias("label")).where(F.col("label").isin("none", *CATEGORIES))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    model = _shared(documents.sparkSession, language_model(documents).tobytes())
    fitted = fitted_scorer(documents, known.where(half == 0), model)
    weights = _shared(documents.sparkSession, (fitted.vocabulary, fitted.weights, fitted.bias))

    @F.pandas_udf("struct<abusive: int, hateful: int, sexual: int, disguised: boolean>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        decoder, judge = _decoder(model), _once(weights, lambda value: Scorer(*value))
        plain = [folded(t) for t in texts]
        rows = [(*s[:3], decoder.restore(p) != p) for s, p in zip(_scores(texts, decoder, judge), plain)]
        return pd.DataFrame(rows, columns=["abusive", "hateful", "sexual", "disguised"])

    votes = known.where(half == 1).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    votes = votes.groupBy("doc_id").agg(F.max(F.struct("n", "label")).alias("top"), F.sort_array(F.collect_list("n"), asc=False).alias("ns")).where("size(ns) = 1 or ns[0] > ns[1]").select("doc_id", F.col("top.label").alias("said"))
    rows = documents.where("text is not null").select("doc_id", "text", F.lower("lang").alias("lang")).join(votes, "doc_id").select("lang", "said", judged("text").alias("j")).select("lang", "said", "j.*")
    flagged = F.col("abusive") + F.col("hateful") + F.col("sexual") > 0
    named = F.when(F.col("said") == "none", ~flagged).otherwise(F.expr("case said when 'abusive' then abusive when 'hateful' then hateful else sexual end > 0"))
    return rows.groupBy("lang", "said", "disguised").agg(F.count("*").alias("documents"), F.count(F.when(flagged, 1)).alias("flagged"), F.count(F.when(named, 1)).alias("named"))


def _inputs(spark, directory: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, directory, "documents"), table(spark, directory, "content_labels")


def p8_found(spark, directory: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit sentence of their own."""
    return content_scores(*_inputs(spark, directory)).where("score > 0.5").select("doc_id")


def p8_scores(spark, directory: str) -> DataFrame:
    return content_scores(*_inputs(spark, directory))


def p8_report(spark, directory: str) -> DataFrame:
    """Per source: documents, documents with each kind of language, and their rate; with the raters' labels beside them."""
    documents, rated = _inputs(spark, directory)
    scored = cut(content_scores(documents, rated))
    labels = rated.groupBy("doc_id").agg(F.avg((F.col("label") != "none").cast("int")).alias("said"))
    joined = scored.join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count("*").alias("documents"), F.count(F.when(F.col("abusive") > 0, 1)).alias("abusive"), F.count(F.when(F.col("hateful") > 0, 1)).alias("hateful"), F.count(F.when(F.col("sexual") > 0, 1)).alias("sexual"),
        F.round(F.avg((F.col("score") > 0.5).cast("int")), 6).alias("rate"), F.count("said").alias("labelled"), F.count(F.when((F.col("said") > 0.5) == (F.col("score") > 0.5), 1)).alias("agreed"),
    )


def p8_holdout(spark, directory: str) -> DataFrame:
    """Held-out agreement of the scorer with the raters, by language, kind and disguise."""
    return held_out(*_inputs(spark, directory))
