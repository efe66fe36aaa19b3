"""Toxicity: a noisy-channel decoder restores obfuscated words, a small model scores the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, settle
from .texts import blocks, each_text, gram_counts, letter_stream

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_SIGN = "".join(re.escape(c) for c in LEET)
_LETTER = r"[^\W\d_]"
#: Letters of a word's beginnings at most.
LONGEST = 12
#: Runs of letters and signs; a letter three times in a row; three letters or more set apart by one to four other characters each.
MIXED = re.compile(rf"(?:{_LETTER}|[{_SIGN}])+")
TRIPLE = re.compile(rf"({_LETTER})\1\1")
RUN = re.compile(rf"{_LETTER}+")
SPACED = re.compile(rf"(?<![^\W_])(?:{_LETTER}|[0134578@$])(?:[\W_]{{1,4}}(?:{_LETTER}|[0134578@$!])){{2,}}(?![^\W_])")
APART = re.compile(rf"{_LETTER}|[0134578@$!]")
#: Log costs of the channel: a sign for a letter, a letter drawn out, a letter for itself, a new word between letters set apart.
COST = {"sign": -2.0, "drawn": -1.5, "same": 0.0, "edge": -1.0}


def trigram_codes(text: str) -> Iterator[np.ndarray]:
    """Letter trigrams of words, their edges included as 0, coded in 21 bits per letter, block by block."""
    for b in blocks(text):
        a = letter_stream(b)
        yield ((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:])[a[1:-1] != 0]


def learn_letters(docs: DataFrame, text_col: str = "text", least: int = 2) -> dict[str, dict]:
    """Counts over all given texts: letter pairs after a letter ("bi") and before one ("after"), all of them, and trigrams ("tri") seen `least` times.

    What a trigram left out would have said is backed off to its pair, whose counts include it, so no mass is lost. The tables are bounded by the
    letters that the texts use, not by their number.
    """
    n = settle(gram_counts(docs.select(F.lit("").alias("_key"), text_col), "_key", text_col, trigram_codes).select("gram", "n"))
    low = (1 << 21) - 1
    sign = lambda c: chr(c) if c else ""
    of = lambda key: {(sign(r["k"] >> 21 & low), sign(r["k"] & low)): r["n"] for r in n.groupBy(key.alias("k")).agg(F.sum("n").alias("n")).collect()}
    tri = {tuple(sign(c) for c in (r["gram"] >> 42, r["gram"] >> 21 & low, r["gram"] & low)): r["n"] for r in n.where(F.col("n") >= least).collect()}
    return {"tri": tri, "bi": of(F.col("gram").bitwiseAND((1 << 42) - 1)), "after": of(F.shiftright("gram", 21))}


class Letters:
    """Letter model: log-probability of a letter after two others, interpolated with shorter contexts. "" is a word's edge."""

    def __init__(self, counts: dict[str, dict]) -> None:
        self.tri, self.bi, self.after2 = (Counter(counts[k]) for k in ("tri", "bi", "after"))
        self.uni, self.after1 = Counter(), Counter()
        for (b, c), n in counts["bi"].items():
            self.uni[c] += n
            self.after1[b] += n
        self.total = sum(self.uni.values()) or 1

    def log(self, a: str, b: str, c: str) -> float:
        p = (self.uni[c] + 0.5) / (self.total + 100)
        p = (self.bi[b, c] + 20 * p) / (self.after1[b] + 20)
        return math.log((self.tri[a, b, c] + 20 * p) / (self.after2[a, b] + 20))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one sign: the strings that it may stand for, with their channel costs."""
    found, at = [], 0
    while at < len(token):
        end = at
        while end < len(token) and token[end] == token[at]:
            end += 1
        n, sign = end - at, token[at]
        letters = [(c, COST["sign"]) for c in LEET.get(sign, "")] or [(sign, COST["same"])]
        options = []
        for c, cost in letters:
            options.append((c, n * cost if n == 1 else cost + COST["drawn"] * (n - 1) / n))
            if n > 1:
                options.append((c + c, 2 * cost + (COST["drawn"] if n > 2 else 0.0)))
        found.append(options)
        at = end
    return found


def restore(token: str, model: Letters, apart: bool = False) -> str:
    """The likeliest text behind a token: Viterbi over its lattice, with the last two letters as the state. Linear in the token's length.

    Letters set apart (`apart`) may also start a new word anywhere, so that a word is found behind those that were spelled out before it.
    """
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("", ""): (0.0, None)}
    for k, options in enumerate(lattice(token)):
        if apart and k:
            options = [*options, *((f" {letters}", cost + COST["edge"]) for letters, cost in options)]
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (p, back) in best.items():
            for letters, cost in options:
                q, x, y = p + cost, a, b
                for c in letters:
                    if c == " ":
                        q += model.log(x, y, "")
                        x = y = ""
                    else:
                        q += model.log(x, y, c)
                        x, y = y, c
                if (x, y) not in new or new[x, y][0] < q:
                    new[x, y] = (q, (back, letters))
        best = new
    back = max(((p + model.log(a, b, ""), k, back) for k, ((a, b), (p, back)) in enumerate(best.items())), key=lambda x: (x[0], -x[1]), default=(0, 0, None))[2]
    found = []
    while back:
        back, letters = back
        found.append(letters)
    return "".join(reversed(found))


def hidden_in(word: str) -> tuple[str, ...]:
    """Tokens of one word without white space that may hide another: signs among letters, drawn-out letters."""
    mixed = (m[0].rstrip("!|+(") for m in MIXED.finditer(word))
    found = [t for t in mixed if any(c in LEET for c in t) and any(c.isalpha() for c in t)]
    if TRIPLE.search(word):
        found += [m[0] for m in RUN.finditer(word) if TRIPLE.search(m[0])]
    return tuple(found)


class _Hidden(dict):
    """hidden_in() of words, kept for the next time; bounded, and without very long words."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        tokens = hidden_in(word)
        if len(word) <= 64:
            if len(self) > 1 << 17:
                self.clear()
            self[word] = tokens
        return tokens


_hidden = _Hidden()


def candidates(text: str) -> Iterator[tuple[str, bool]]:
    """(token, set apart) of a lower-case text: tokens that may hide a word inside its distinct words, and letters set apart."""
    for token in chain.from_iterable(map(_hidden.__getitem__, set(text.split()))):
        yield token, False
    for m in SPACED.finditer(text):
        yield "".join(APART.findall(m[0])), True


def restored(text: str, model: Letters, known: dict[tuple[str, bool], str]) -> str:
    """The text in lower case, followed by the words restored from its obfuscated tokens."""
    low = text.lower()
    words = []
    for token in set(candidates(low)):
        word = known.get(token)
        if word is None:
            word = restore(token[0], model, token[1])
            if token[1]:  # a word may start at any of the letters set apart
                joined = word.replace(" ", "")
                word = " ".join([word, *(joined[i : i + LONGEST] for i in range(1, len(joined) - 3))])
            if len(known) > 1 << 16:
                known.clear()
            if len(word) <= 64:
                known[token] = word
        words.append(word)
    return f"{low} {' '.join(sorted(words))}" if words else low




def features(text: str) -> set[str]:
    """Words of a restored text and their beginnings of four letters and more."""
    return {w[:k] for w in set(RUN.findall(text)) for k in range(min(4, len(w)), min(len(w), LONGEST) + 1)}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000, max_features: int = 20_000) -> dict:
    """The model: letter counts over all texts that are not held out, and a logistic regression over word beginnings of restored texts.

    The regression is fitted on a bounded sample: the `fit_rows` labelled, not held-out ids with the smallest hashes. Its candidates are the beginnings
    that two toxic rows or more have, at three times the rate of clean ones, the `max_features` with the most evidence. An elastic net chooses among
    them; the chosen ones are weighted again without its shrinking, so that the score is a probability, and share it with the net's own weights,
    which rank texts with weak evidence. Ids with null labels are not used; an id with several labels counts as toxic if one says so. Without toxic
    and clean rows there are no weights, and every text scores the share of toxic rows.
    """
    train = docs.where(~held_out(F.col(id_col)))
    letters = learn_letters(train, text_col)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)
    model = Letters(letters)
    fit = train.select(id_col, F.col(text_col).alias("_t")).join(F.broadcast(settle(chosen)), id_col)  # at most fit_rows ids
    rows = settle(each_text(fit, id_col, "_t", "words array<string>", lambda t, known={}: (sorted(features(restored(t, model, known))),), ("_y",)))
    total = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    base = math.log((toxic + 0.5) / (clean + 0.5))
    counts = rows.select("_y", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("_y") == 1).alias("t"), F.count_if(F.col("_y") == 0).alias("c"))
    counts = counts.where(F.col("t") * clean >= 3 * (F.col("c") + 0.5) * toxic).where("t >= 2")
    words = [r["word"] for r in counts.orderBy(F.desc(F.col("t") * F.log((F.col("t") + 0.5) * (clean + 1) / ((F.col("c") + 0.5) * (toxic + 1)))), "word").limit(max_features).collect()] if toxic and clean else []
    if not words:
        return {"letters": letters, "weights": {}, "base": base}
    held = rows.select(F.col("_y").cast("double"), "words").coalesce(8)
    net, _ = regression(held, words, net=0.5, strength=0.005)
    if not net:
        return {"letters": letters, "weights": {}, "base": base}
    best, base = regression(held, sorted(net), net=0.0, strength=2e-4)
    return {"letters": letters, "weights": {w: best.get(w, 0.0) + net[w] / 10 for w in net}, "base": base}


def regression(rows: DataFrame, words: list[str], net: float, strength: float) -> tuple[dict[str, float], float]:
    """(weights of the words that help toxic texts, intercept) of a logistic regression on rows (_y, words)."""
    vectors = CountVectorizerModel.from_vocabulary(words, "words", "_f").setBinary(True).transform(rows)
    fitted = LogisticRegression(featuresCol="_f", labelCol="_y", elasticNetParam=net, regParam=strength, maxIter=60, standardization=False).fit(vectors)
    return {w: float(x) for w, x in zip(words, fitted.coefficients.toArray()) if x > 0}, float(fitted.intercept)


@lru_cache(8)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: (id, score from 0 to 1, predicted 0 or 1).

    The restored whole text is searched for the model's word beginnings; each adds its weight once. Null and empty texts score what texts without any
    of them do, as do texts that tie in what they have. Repeated rows are scored each; an empty table gives no rows; texts of any length are
    searched whole, in time linear in their length; other columns are ignored, whatever their names.
    """
    weights, base, letters = model["weights"], model["base"], Letters(model["letters"])
    known: dict[tuple[str, bool], str] = {}
    words = tuple(sorted(weights))

    def run(text: str) -> tuple[float, int]:
        found = set()
        if words:
            text = restored(text, letters, known)
            for end, word in _automaton(words).iter(text):
                at = end - len(word)
                if word not in found and not (at >= 0 and text[at].isalpha()):
                    found.add(word)
        odds = base + sum(weights[w] for w in sorted(found))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        return p, int(p >= threshold)

    return each_text(docs, id_col, text_col, "score double, predicted int", run)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 20_000) -> DataFrame:
    """(id, held_out, score, predicted) for every row, with a model learned from the rows that are not held out; see learn() and score().

    Nulls, empty and very long texts, ties, repeated rows, empty tables and other columns are as score() says; labels without a row are ignored.
    """
    scored = score(docs, learn(docs, labels, id_col, text_col, label_col, fit_rows), id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
