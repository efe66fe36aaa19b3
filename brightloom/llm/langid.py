"""Language ID by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, settle
from .texts import counted, each_text, gram_counts, grams

UNKNOWN = "und"


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> dict[str, list[int]]:
    """The `size` most frequent letter n-grams (1 to 3 letters) of each language, most frequent first, over all given rows with a language.

    Ties go to the smaller code. Counting is distributed; only languages x size codes come to the driver, 3 KB a language.
    """
    n = settle(gram_counts(docs.where(F.col(lang_col).isNotNull()), lang_col, text_col, grams))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "gram"))
    rows = n.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["rank"])):
        found.setdefault(r["key"], []).append(r["gram"])
    return found


class Profiles:
    """The places of n-grams in the languages' profiles: for each code, in order, the languages that have it and its rank there."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(profiles), size
        lengths = [len(profiles[n]) for n in self.names]
        code = np.array([c for n in self.names for c in profiles[n]], np.int64).view(np.uint64)
        order = np.argsort(code, kind="stable")
        self.codes, self.start = np.unique(code[order], return_index=True)
        self.end = np.append(self.start[1:], code.size)
        self.lang = np.repeat(np.arange(len(lengths)), lengths)[order]
        self.rank = np.array([r for k in lengths for r in range(k)], np.int64)[order]

    def nearest(self, text: str) -> tuple[str, float]:
        """The language at the least out-of-place distance from the text's own most frequent n-grams, and the likeness.

        An n-gram that a profile lacks is `size` places out, so each that it has saves `size` less the places between.
        """
        own, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for g in grams(text):
            if g.size:
                new = np.unique(g, return_counts=True)
                own, n = counted([(own, n), new]) if own.size else new
        if not own.size or not self.codes.size:
            return UNKNOWN, 0.0
        if own.size > self.size:
            least = np.partition(n, own.size - self.size)[own.size - self.size]
            own, n = own[n >= least], n[n >= least]
        own = own[np.lexsort((own, -n))[: self.size]]
        at = np.minimum(np.searchsorted(self.codes, own), self.codes.size - 1)
        place = np.flatnonzero(self.codes[at] == own)
        first, width = self.start[at[place]], (self.end - self.start)[at[place]]
        entry = np.arange(width.sum()) + np.repeat(first - np.cumsum(width) + width, width)
        saved = np.bincount(self.lang[entry], self.size - np.abs(self.rank[entry] - np.repeat(place, width)), len(self.names))
        best = int(np.argmax(saved))
        return self.names[best], float(saved[best] / (self.size * own.size))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, lang_pred, score): the language whose profile is nearest to the document's own `size` most frequent n-grams.

    score is 1 less the out-of-place distance over its maximum. Ties go to the first language by name. Texts that are null or have no letter, and all
    texts if there is no profile, are `und` with score 0. Texts of any length are read whole, block by block. Repeated rows are kept, an empty table gives no
    rows. Columns that are not carried are ignored, whatever their names; carried ones may not be named lang_pred or score.
    """
    known = Profiles(profiles, size)
    return each_text(docs, id_col, text_col, "lang_pred string, score double", known.nearest, carry)


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """identify() with profiles learned from the rows of the same table that are not held out and have a language; all cases as there."""
    train = docs.where(~held_out(F.col(id_col)))
    return identify(docs, learn_profiles(train, text_col, lang_col, size), id_col, text_col, size, carry)
