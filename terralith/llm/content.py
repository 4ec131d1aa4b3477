"""A scorer of sentences for problem 8: concepts of `lexicon` with weights set beforehand, corrected by what labelled texts teach.

A sentence is a bag of features: which concepts stand in it, which stand close together, and its words and pairs of neighbouring
words. For each category the logarithm of the odds is the sum of the features' weights. The concepts' weights start from
values set by hand, all others from 0; labelled documents move them (logistic regression, drawn back to where they started). A
label belongs to a document, not to a sentence, so a document counts by its likeliest sentence; raters err, so each document's
label is weighed by how far raters who saw the same document disagree. With no labels at all the starting values decide.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

from terralith.llm.lexicon import CONCEPTS, IDIOMS, NO_PEOPLE, PEOPLE_ENDINGS

CATEGORIES = ("abusive", "hateful", "sexual")
#: Words and pairs of words are learnt if at least so many labelled documents hold them.
LEAST_DOCUMENTS = 3
#: Rounds of giving labels to sentences, and steps of the regression in each.
ROUNDS, STEPS, RATE = 3, 20, 0.3
#: Log odds below which the likeliest sentence of a text shows nothing to learn from.
UNSEEN = -2.5
#: How strongly weights are drawn to their start: words, concepts.
PULL_WORD, PULL_CONCEPT = 1.0, 1.0
BIAS = -6.0
#: Smaller weights are left out of the fitted scorer.
LEAST_WEIGHT = 0.05
#: Weight of a sentence that makes a text a case, against one of a text that is none: cases are few.
POSITIVE = 8.0
_BREAKS = bytes(i if 97 <= i <= 122 or 48 <= i <= 57 else 32 for i in range(256))
#: The same, but for the ends of lines; a word that no folded text holds, as it is upper case.
_LINES, _END = _BREAKS[:10] + b"\n" + _BREAKS[11:], "A"

_EXACT: dict[str, list[str]] = {}
_PREFIX: dict[str, list[str]] = {}
for _concept, _list in CONCEPTS.items():
    for _w in _list.split():
        _at = (_PREFIX, _w[:-1]) if _w.endswith("*") else (_EXACT, _w)
        if _concept not in _at[0].setdefault(_at[1], []):
            _at[0][_at[1]].append(_concept)
_SHORTEST = min(map(len, _PREFIX))
_STEMS = {w[:_SHORTEST] for w in _PREFIX}
_IDIOMS: dict[str, list[tuple[str, ...]]] = {}
for _phrase in IDIOMS:
    _IDIOMS.setdefault(_phrase.split()[0], []).append(tuple(_phrase.split()))
#: Concepts that make the features below worth computing; every one of those needs one of these.
_RISKY = frozenset("insult scorn curse order harm slur dehuman remove explicit sexual act idiom".split())

#: Concepts that stand at most so many words apart: name, one, other, distance, in this order only.
NEARBY = [
    ("insult+second", "insult", "second", 5, False), ("scorn+insult", "scorn", "insult", 2, True), ("curse+second", "curse", "second", 3, False), ("scorn+second", "scorn", "second", 4, False), ("order+second", "order", "second", 3, True),
    ("harm+second", "harm", "second", 4, False), ("harm+near", "harm", "near", 4, True), ("insult+thing", "insult", "thing", 2, True), ("group+dehuman", "group", "dehuman", 7, False), ("group+remove", "group", "remove", 8, False),
    ("harm+group", "harm", "group", 4, True), ("they+dehuman", "they", "dehuman", 4, True), ("they+remove", "they", "remove", 6, False), ("group+insult", "group", "insult", 5, True), ("negate+right", "negate", "right", 4, True), ("scorn+group", "scorn", "group", 2, True),
    ("act+person", "act", "person", 3, False), ("sexual+person", "sexual", "person", 5, False), ("explicit+person", "explicit", "person", 5, False), ("sexual+sexual", "sexual", "sexual", 4, True), ("explicit+explicit", "explicit", "explicit", 6, True), ("explicit+sexual", "explicit", "sexual", 5, False), ("every+group", "every", "group", 3, True),
]
#: Where weights start: by feature, for abusive, hateful, sexual.
START = {
    "#insult+second": (7.5, 0, 0), "#scorn+insult": (7.0, 0, 0), "#curse+second": (7.0, 0, 0), "#scorn+second": (3.0, 0, 0), "#order+second": (3.0, 0, 0), "#harm+second": (4.5, 0, 0), "#harm+second+will": (3.0, 0, 0), "#harm+near+second": (2.5, 0, 0),
    "#idiom": (7.0, 0, 0), "#idiom+insult": (1.5, 0, 0), "#insult": (1.0, 0, 0), "#curse": (1.5, 0, 0.5), "#insult+thing": (-5.0, 0, 0), "#deserve+harm+second": (2.0, 0, 0),
    "#slur": (0, 8.0, 0), "#group+dehuman": (0, 7.0, 0), "#group+remove": (0, 4.0, 0), "#group+remove+deserve": (0, 4.0, 0), "#harm+group": (0, 6.0, 0), "#every+group": (0, 1.0, 0), "#they+dehuman": (0, 3.5, 0), "#they+remove+deserve": (0, 5.0, 0), "#group+insult": (0, 4.5, 0), "#negate+right+group": (0, 7.5, 0), "#scorn+group": (0, 3.0, 0), "#dehuman+remove+group": (0, 2.0, 0),
    "#explicit": (0, 0, 4.0), "#explicit+explicit": (0, 0, 4.0), "#explicit+sexual": (0, 0, 4.5), "#explicit+person": (0, 0, 4.0), "#act+person": (0, 0, 2.5), "#act+person+curse": (0, 0, 5.0), "#sexual+sexual": (0, 0, 2.5), "#sexual+person": (0, 0, 1.0), "#explicit+second": (0, 0, 1.5),
    "#report": (-3.0, -3.5, -2.0), "#thing": (-0.5, -0.5, -1.0),
}


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of a folded text."""
    return text.encode().translate(_BREAKS).decode().split()


def concepts_of(word: str, memo: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    found = memo.get(word)
    if found is None:
        names = list(_EXACT.get(word, ()))
        if word[:_SHORTEST] in _STEMS:
            for n in range(_SHORTEST, len(word) + 1):
                names += [c for c in _PREFIX.get(word[:n], ()) if c not in names]
        if "group" not in names and len(word) > 5 and word.endswith(PEOPLE_ENDINGS) and word not in NO_PEOPLE:
            names.append("group")
        if len(memo) > 300_000:
            memo.clear()
        found = memo[word] = tuple(names)
    return found


#: Insults of at least LEAST_RESPELT letters, by their length and the letters that a slip in the other half leaves: the first ones, or the first and the last ones.
LEAST_RESPELT = 5
_BY_LENGTH: dict[int, tuple[int, int, dict[str, list[str]], dict[str, list[str]]]] = {}
for _c in ("insult", "scorn", "slur"):
    for _w in CONCEPTS[_c].split():
        if len(_w) >= LEAST_RESPELT and not _w.endswith("*"):
            # two neighbours that are swapped touch one of both parts only: a letter stands between these
            _p, _q, _begun, _ended = _BY_LENGTH.setdefault(len(_w), (len(_w) // 2, len(_w) - 1 - len(_w) // 2, {}, {}))
            for _held, _part in ((_begun, _w[:_p]), (_ended, _w[0] + _w[-_q:])):
                if _w not in _held.setdefault(_part, []):
                    _held[_part].append(_w)


_HEADS, _TAILS = ({part(w) for n in _BY_LENGTH.values() for ws in n[2].values() for w in ws} for part in (lambda w: w[:2], lambda w: w[-2:]))


def _one_slip(a: str, b: str) -> bool:
    """Whether one letter put in, left out, altered, or swapped with its neighbour makes `b` of `a`."""
    if abs(len(a) - len(b)) > 1 or a[0] != b[0]:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(x) > 1 and len(y) > 1 and x[2:] == y[2:])


def respelt(word: str, known, memo: dict[str, str]) -> str:
    """`word`, or the insult that it is one slip away from if it is no `known` word of the texts taught with. The first letter stands."""
    found = memo.get(word)
    if found is None:
        found = word
        # one slip leaves the first two letters as they are, or the last two
        if len(word) >= LEAST_RESPELT and (word[:2] in _HEADS or word[-2:] in _TAILS) and word not in known and not _EXACT.get(word):
            for n in (len(word) - 1, len(word), len(word) + 1):
                if n in _BY_LENGTH:
                    p, q, begun, ended = _BY_LENGTH[n]
                    near = [w for w in (*begun.get(word[:p], ()), *ended.get(word[0] + word[-q:], ())) if _one_slip(word, w)]
                    if near and (found is word or min(near) < found):
                        found = min(near)
        if len(memo) > 300_000:
            memo.clear()
        memo[word] = found
    return found


def _close(a: list[int], b: list[int], most: int, ordered: bool) -> bool:
    return any(i != j and (0 < j - i <= most if ordered else abs(j - i) <= most) for i in a for j in b)


def concept_features(words: list[str], memo: dict) -> list[str]:
    """Features of a sentence's concepts; none for a sentence without a risky one."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for c in concepts_of(w, memo):
            at.setdefault(c, []).append(i)
        for phrase in _IDIOMS.get(w, ()):
            if tuple(words[i : i + len(phrase)]) == phrase:
                at.setdefault("idiom", []).append(i)
    if not _RISKY.intersection(at):
        return []
    out = ["#" + c for c in at]
    close = {name for name, a, b, most, ordered in NEARBY if a in at and b in at and _close(at[a], at[b], most, ordered)}
    out += ["#" + c for c in close]
    for name, part, more in (("harm+second", "will", 0), ("harm+near", "second", 0), ("group+remove", "deserve", 0), ("they+remove", "deserve", 0), ("negate+right", "group", 0), ("act+person", "curse", 0)):
        if name in close and part in at:
            out.append(f"#{name}+{part}")
    for names in (("idiom", "insult"), ("deserve", "harm", "second"), ("explicit", "second"), ("dehuman", "remove", "group")):
        if all(n in at for n in names):
            out.append("#" + "+".join(names))
    return out


def sentences(text: str) -> list[str]:
    """What stands between line ends, and behind a full stop, exclamation or question mark that a blank follows."""
    for blank in "\t\r\x0b\x0c":
        if blank in text:
            text = text.replace(blank, " ")
    return [s for s in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if s and not s.isspace()]


def learnt_terms(words: list[str], common: set[str]) -> set[str]:
    """The common words of a sentence, and the pairs of neighbours of which both are common."""
    held = [w if w in common else None for w in words]
    out = {f"{a} {b}" for a, b in zip(held, held[1:]) if a is not None and b is not None}
    out.update(held)
    out.discard(None)
    return out


class _Known(dict):
    """What words are to a scorer, looked up when first met: spelling, row or -1, rows of the pairs it begins, whether it is risky."""

    def __init__(self, scorer: "Scorer"):
        super().__init__()
        self.scorer = scorer

    def __missing__(self, word: str) -> tuple:
        of, plain, risky = self.scorer, word, False
        # most words are names met once: nothing that they begin or end with needs a closer look
        if word[:2] in _HEADS or word[-2:] in _TAILS:
            plain = respelt(word, of.vocabulary, of.slips)
        if plain in _IDIOMS or plain in _EXACT or plain[:_SHORTEST] in _STEMS:
            risky = plain in _IDIOMS or not _RISKY.isdisjoint(concepts_of(plain, of.memo))
        entry = self[word] = (plain, of.vocabulary.get(plain, -1), of.pairs.get(plain), risky)
        return entry


def _risky(plain: str, memo: dict) -> bool:
    """Whether a word makes the features of concepts worth computing."""
    return (plain in _IDIOMS or plain in _EXACT or plain[:_SHORTEST] in _STEMS) and (plain in _IDIOMS or not _RISKY.isdisjoint(concepts_of(plain, memo)))


class _Numbers(dict):
    """Numbers of words, looked up when first met: 0 says nothing, 1 ends a sentence, 2 is risky only, others are the scorer's own."""

    def __init__(self, scorer: "Scorer"):
        super().__init__()
        self.scorer = scorer

    def __missing__(self, word: str) -> int:
        of, plain = self.scorer, word
        if word[:2] in _HEADS or word[-2:] in _TAILS:
            plain = respelt(word, of.vocabulary, of.slips)
        k = of.own.get(plain)
        if k is None:
            k = 2 if _risky(plain, of.memo) else 0
        self[word] = k
        return k


class Scorer:
    """Weights of features by category. `vocabulary` maps a word, a pair of words or a concept feature to its row of weights."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        self.vocabulary, self.weights, self.bias, self.memo, self.slips = vocabulary, weights, bias, {}, {}
        self.rows = [tuple(map(float, w)) for w in weights]
        self.base = tuple(map(float, bias))
        self.pairs: dict[str, dict[str, int]] = {}
        for term, k in vocabulary.items():
            if " " in term:
                first, second = term.split(" ", 1)
                self.pairs.setdefault(first, {})[second] = k
        self.known = _Known(self)
        self.table = np.asarray(weights, np.float64).reshape(-1, 3)
        # own words are those of the vocabulary and of its pairs
        own = dict.fromkeys(w for t in vocabulary if not t.startswith("#") for w in t.split(" "))
        self.own = {_END: 1} | {w: i for i, w in enumerate(own, 3)}
        self.row = np.array([-1, -1, -1, *(vocabulary.get(w, -1) for w in own)], np.int64)
        self.risky = np.array([False, False, True, *(_risky(w, self.memo) for w in own)])
        joined = sorted((self.own[a] * len(self.row) + self.own[b], k) for a, ends in self.pairs.items() for b, k in ends.items())
        self.joined, self.joined_row = np.array([(j, k) for j, k in joined] or [(-1, -1)], np.int64).T.copy()
        self.numbers = _Numbers(self)

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log odds of each category for many sentences at once: what `sentence` says of each, but for the last bits of the sums."""
        words = "\n".join(texts).encode().translate(_LINES).replace(b"\n", b" A ").decode().split()
        if len(self.numbers) > 300_000:
            self.numbers.clear()
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        at = np.cumsum(ids == 1)
        row, key = self.row[ids], ids[:-1] * len(self.row) + ids[1:]
        place = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
        alone, pair = np.flatnonzero(row >= 0), np.flatnonzero((self.joined[place] == key) & (ids[:-1] > 2) & (ids[1:] > 2))
        # a feature counts once in a sentence
        held = np.sort(np.concatenate([at[alone] * len(self.table) + row[alone], at[pair] * len(self.table) + self.joined_row[place[pair]]]))
        of, term = np.divmod(held[np.append(True, held[1:] != held[:-1])[: len(held)]], max(len(self.table), 1))
        out = np.stack([np.bincount(of, self.table[term, c], len(texts)) + self.base[c] for c in range(3)], 1)
        for k in np.unique(at[self.risky[ids]]).tolist():
            out[k] = self.sentence(texts[k])
        return out

    def sentence(self, text: str) -> tuple[float, float, float]:
        """Log odds of each category."""
        words = words_of(text)
        rows, found, risky, pairs = self.rows, set(), False, None
        if len(self.known) > 300_000:
            self.known.clear()
        for plain, k, begun, bad in map(self.known.__getitem__, words):
            if k >= 0:
                found.add(k)
            if pairs is not None and plain in pairs:
                found.add(pairs[plain])
            pairs = begun
            if bad:
                risky = True
        if risky:
            get, known = self.vocabulary.get, self.known
            found.update(k for k in map(get, concept_features([known[w][0] for w in words], self.memo)) if k is not None)
        a, h, s = self.base
        for k in found:
            x, y, z = rows[k]
            a += x
            h += y
            s += z
        return a, h, s


def start_scorer() -> Scorer:
    """The scorer before anything was learnt."""
    return train([], [])


def _bags(texts: list[str]):
    """Sentences of all texts as features laid end to end: vocabulary, feature numbers, sentence starts, text of each sentence."""
    memo: dict[str, tuple[str, ...]] = {}
    looked: dict[str, tuple[str, bool]] = {}
    slips: dict[str, str] = {}
    per_text, seen = [], Counter()
    common = {w for w, n in Counter(w for text in texts for w in set(words_of(text))).items() if n >= LEAST_DOCUMENTS}
    for text in texts:
        rows = []
        for s in sentences(text):
            words, risky = [], False
            for w in words_of(s):
                if w not in looked:
                    plain = respelt(w, common, slips)
                    looked[w] = plain, plain in _IDIOMS or not _RISKY.isdisjoint(concepts_of(plain, memo))
                words.append(looked[w][0])
                risky = risky or looked[w][1]
            rows.append((learnt_terms(words, common), concept_features(words, memo) if risky else []))
        per_text.append(rows)
        seen.update(set().union(*(r[0] for r in rows)) if rows else ())
    vocabulary = {f: i for i, f in enumerate(START)}
    for rows in per_text:
        for _, concepts in rows:
            for f in concepts:
                vocabulary.setdefault(f, len(vocabulary))
    concepts = len(vocabulary)
    for term in sorted(t for t, n in seen.items() if n >= LEAST_DOCUMENTS):
        vocabulary[term] = len(vocabulary)
    flat, starts, owner = [], [], []
    for t, rows in enumerate(per_text):
        for terms, found in rows:
            starts.append(len(flat))
            flat += [vocabulary[f] for f in found]
            flat += [vocabulary[x] for x in terms if x in vocabulary]
            flat.append(-1)  # no sentence is empty; the last row of weights is 0
            owner.append(t)
    return vocabulary, concepts, np.asarray(flat, np.int32), np.asarray(starts, np.int64), np.asarray(owner, np.int64)


def train(texts: list[str], ratings: list[list[str]]) -> Scorer:
    """A scorer from restored texts and the labels that raters gave them (`none` or a category; others are ignored).

    Texts without a known label teach nothing. No texts give the starting weights.
    """
    pairs = [(t, [x for x in r if x == "none" or x in CATEGORIES]) for t, r in zip(texts, ratings) if t]
    pairs = [(t, r) for t, r in pairs if r]
    vocabulary, concepts, flat, starts, owner = _bags([t for t, _ in pairs])
    size = len(vocabulary)
    begin = np.zeros((size + 1, 3))
    for name, values in START.items():
        begin[vocabulary[name]] = values
    weights, bias = begin.copy(), np.full(3, BIAS)
    if not pairs:
        return Scorer(vocabulary, weights[:size], bias)
    # how often raters err: disagreement with the majority of three or more; a small prior where few texts have that many
    wrong, rated = 1.0, 20.0
    for _, r in pairs:
        if len(r) >= 3:
            wrong, rated = wrong + len(r) - Counter(r).most_common(1)[0][1], rated + len(r)
    error = min(max(wrong / rated, 0.01), 0.3)
    n = len(pairs)
    # log odds, from the raters alone, that a text holds each category
    said = np.array([[sum((1 if x == c else -1 if x == "none" else 0) for x in r) for c in CATEGORIES] for _, r in pairs], float) * np.log((1 - error) / error)
    lengths = np.diff(np.append(starts, len(flat)))
    sentence_of = np.repeat(np.arange(len(starts)), lengths)
    pull = np.where(np.arange(size + 1) < concepts, PULL_CONCEPT, PULL_WORD)[:, None]
    # texts with a label of their own category share words that texts without one lack: where the first round looks
    first = np.searchsorted(owner, np.arange(n))
    hint = np.zeros((size + 1, 3))
    own_text, own_term = owner[sentence_of], np.where(flat < 0, size, flat)
    for c in range(3):
        yes = np.bincount(own_term, weights=(said[own_text, c] > 0).astype(float), minlength=size + 1)
        no = np.bincount(own_term, weights=(said[own_text] <= 0).all(1).astype(float), minlength=size + 1)
        totals = max((said[:, c] > 0).sum(), 1), max((said <= 0).all(1).sum(), 1)
        odds = np.log((yes + 0.5) / (totals[0] + 1)) - np.log((no + 0.5) / (totals[1] + 1))
        hint[:, c] = np.where((np.arange(size + 1) >= concepts) & (np.arange(size + 1) < size) & (yes >= LEAST_DOCUMENTS), np.clip(odds, 0, 4) * 0.5, 0)

    places = np.where(flat < 0, size, flat)
    order = np.argsort(places, kind="stable")
    held, by = np.unique(places[order], return_index=True)
    rows_of = sentence_of[order]  # sentences of each feature in turn

    def logits(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(w[places, c], starts) for c in range(3)], 1) + b

    clear = (said[owner] <= 0).all(1)
    for turn in range(ROUNDS):
        z = logits(weights + (hint if turn == 0 else 0), bias)
        best = np.stack([np.maximum.reduceat(z[:, c], first) for c in range(3)], 1)
        # what raters say and, from the second round on, the model itself decide what a text holds
        target = 1 / (1 + np.exp(-(said + (np.clip(best, -3, 3) if turn else 0))))
        # a text counts by its likeliest sentence, if that shows anything at all; a text that raters cleared by all of them
        top = (z >= best[owner]) & (z > UNSEEN)
        label = np.where(top, target[owner], 0.0)
        label = np.where(clear[:, None] & (label < 0.5), 0.0, label)
        weight = np.where(top, POSITIVE, np.where(clear[:, None], 1.0, 0.0))
        moment, square = np.zeros_like(weights), np.zeros_like(weights)
        moment_bias, square_bias = np.zeros(3), np.zeros(3)
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(logits(weights, bias), -30, 30)))
            rest = weight * (p - label)
            slope = pull * (weights - begin)
            for c in range(3):
                slope[held, c] += np.add.reduceat(rest[rows_of, c], by)
            slope[size] = 0
            slope_bias = rest.sum(0) + 5.0 * (bias - BIAS)
            moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            moment_bias, square_bias = 0.9 * moment_bias + 0.1 * slope_bias, 0.99 * square_bias + 0.01 * slope_bias**2
            one, two = 1 - 0.9**step, 1 - 0.99**step
            rate = RATE * (1 - 0.8 * step / STEPS)
            weights -= rate * (moment / one) / (np.sqrt(square / two) + 1e-6)
            bias -= 0.3 * rate * (moment_bias / one) / (np.sqrt(square_bias / two) + 1e-6)
    kept = np.abs(weights[:size]).max(1) > LEAST_WEIGHT
    names = [t for t, k in vocabulary.items() if kept[k]]
    return Scorer({t: i for i, t in enumerate(names)}, weights[[vocabulary[t] for t in names]].astype(np.float32), bias)
