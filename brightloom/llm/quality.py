"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text gives each document's perplexity.

The model's unit is a sign: a UTF-16 code unit of the folded text, so no character of any script is left out and rare ones are spelled with two
signs. An n-gram of ORDER signs fills 64 bits. Counts, continuation counts, discounts and the probabilities of all n-grams that the documents have are
Spark groupings and joins, sharded by n-gram and by context. A document's log-probability is the sum over its n-grams, in fixed point, so it does not
depend on the order of the sum: whether the looked-up probabilities go to the workers (up to `ship_rows` of them, a checked number) or are joined to the
documents' n-grams by shuffle, each perplexity is the same to the bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, written
from .texts import blocks, code_points, each_text, gram_counts

ORDER = 4
#: Signs have 16 bits. Those of no character: what stands before a text, and what says that a capital follows.
BITS, START, CAPITAL = 16, 0, 0xFFFE
#: Fixed point of log-probabilities.
SCALE = 1 << 24


@lru_cache(1)
def folded() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case form (digits as 0, white space and NUL as a space), and whether it is a capital."""
    low, capital = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isdigit():
            low[c] = ord("0")
        elif ch.isspace() or not c:
            low[c] = ord(" ")
        elif (x := ch.lower()) != ch and len(x) == 1:
            low[c], capital[c] = ord(x), True
    return low, capital


def signs(text: str) -> np.ndarray:
    """The text as signs: capitals as CAPITAL and the small letter, characters beyond 16 bits as their two surrogates."""
    cp = code_points(text)
    low, capital = folded()
    cp, capital = low[cp], capital[cp]
    wide = cp >= 0x10000
    size = 1 + capital + wide
    end = np.cumsum(size)
    out = np.full(int(end[-1]) if cp.size else 0, CAPITAL, np.uint64)
    out[end - 1] = np.where(wide, 0xDC00 | (cp & 0x3FF), cp)
    out[end[wide] - 2] = 0xD800 | ((cp[wide] - 0x10000) >> 10)
    return out


def grams_of(text: str) -> Iterator[np.ndarray]:
    """Codes of all ORDER-grams, one for each sign of the text, block by block; the text starts after ORDER - 1 START signs."""
    before = np.full(ORDER - 1, START, np.uint64)
    for b in blocks(text):
        s = np.concatenate([before, signs(b)])
        before = s[-(ORDER - 1) :]
        code = np.zeros(s.size - ORDER + 1, np.uint64)
        for i in range(ORDER):
            code = (code << np.uint64(BITS)) | s[i : s.size - ORDER + 1 + i]
        yield code


def last(gram: Column, k: int) -> Column:
    """The last k signs of an n-gram."""
    return gram if k == ORDER else gram.bitwiseAND((1 << BITS * k) - 1)


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (gram, alpha) and (context, gamma), so that p(sign | context) = alpha + gamma * p(sign | shorter context).

    counts: (gram, n) of order ORDER. Lower orders count the distinct signs before an n-gram. Discounts D1, D2 and D3+ come from each order's
    counts of counts; where those are too few to estimate them (small or odd tables), 0.5, 1 and 1.5 stand in.
    """
    found = []
    table = counts
    for order in range(ORDER, 0, -1):
        table = settle(table)
        c = {r["k"]: r["m"] for r in table.where("n <= 4").groupBy(F.col("n").alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}
        d = [0.5, 1.0, 1.5]
        if all(c.get(k) for k in (1, 2, 3, 4)):
            y = c[1] / (c[1] + 2 * c[2])
            d = [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.05), k - 0.05) for k in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = table.withColumn("context", F.shiftrightunsigned("gram", BITS)).withColumn("cut", cut)
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3"))
        cuts = F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]  # not a sum of doubles, which would depend on its order
        alpha = rows.join(sums, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("alpha"))
        found.append((settle(alpha), settle(sums.select("context", (cuts / F.col("total")).alias("gamma")))))
        table = table.groupBy(last(F.col("gram"), order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return found[::-1]


def probabilities(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, log_p): the log-probability of each n-gram's last sign after the others, in units of 1 / SCALE, by joins of sharded counts.

    Below the first order all signs are equally likely, so nothing has probability 0.
    """
    p = grams.withColumn("p", F.lit(1.0 / (1 << BITS)))
    for k, (alpha, gamma) in enumerate(tables):
        p = p.withColumn("_g", last(F.col("gram"), k + 1)).withColumn("_c", F.shiftrightunsigned(last(F.col("gram"), k + 1), BITS))
        p = p.join(gamma.withColumnRenamed("context", "_c"), "_c", "left").join(alpha.withColumnRenamed("gram", "_g"), "_g", "left")
        p = p.select("gram", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return p.select("gram", F.round(F.log("p") * SCALE).cast("long").alias("log_p"))


def merged_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text with their counts, merged block by block, so that memory follows what is distinct."""
    codes, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for c in grams_of(text):
        c, k = np.unique(c, return_counts=True)
        if codes.size:
            codes, at = np.unique(np.concatenate([codes, c]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, k]), codes.size).astype(np.int64)
        else:
            codes, n = c, k
    return codes, n


def perplexities(docs: DataFrame, trusted: Column, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), ship_rows: int = 4_000_000, scored: DataFrame | None = None) -> DataFrame:
    """(id, carried columns, signs, perplexity) for every row; the model is trained on the rows where `trusted` is true.

    `scored`: the same texts without what `trusted` needs, so that a join that finds the trusted rows is run for the counts only.
    Null and empty texts have no sign and a null perplexity. Without a trusted text all signs are equally likely.
    """
    key = F.when(trusted, "t").otherwise("o")
    every = settle(gram_counts(docs.select(key.alias("_key"), text_col), "_key", text_col, grams_of))
    tables = kneser_ney(every.where("key = 't'").select("gram", "n"))
    p = settle(probabilities(every.select("gram").distinct(), tables))
    docs = docs if scored is None else scored
    if p.count() <= ship_rows:
        model = docs.sparkSession.sparkContext.broadcast(Table(p))
        summed = each_text(docs, id_col, text_col, "signs long, log_p long", lambda t: model.value.log_sum(t), carry)
    else:
        summed = joined_sums(docs, p, id_col, text_col, carry)
    mean = -F.col("log_p") / (F.col("signs") * F.lit(float(SCALE)))
    return summed.select(id_col, *carry, "signs", F.when(F.col("signs") > 0, F.exp(mean)).alias("perplexity"))


class Table:
    """Log-probabilities of n-grams, at most `ship_rows` of them, for workers to look up."""

    def __init__(self, p: DataFrame) -> None:
        t = p.toArrow()
        codes, log_p = t.column("gram").to_numpy().astype(np.int64).view(np.uint64), t.column("log_p").to_numpy().astype(np.int64)
        order = np.argsort(codes)
        self.codes, self.log_p = codes[order], log_p[order]

    def log_sum(self, text: str) -> tuple[int, int]:
        """(signs, sum of their log-probabilities)."""
        n, total = 0, 0
        for c in grams_of(text):
            n += c.size
            total += int(self.log_p[np.searchsorted(self.codes, c)].sum())
        return n, total


def joined_sums(docs: DataFrame, p: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(id, carried columns, signs, log_p) with the probabilities left in their table: each row's distinct n-grams are joined to it."""

    def own(text: str) -> tuple[list, list]:
        code, n = merged_codes(text)
        return code.view(np.int64).tolist(), n.tolist()

    rows = settle(each_text(docs, id_col, text_col, "grams array<long>, ns array<long>", own, carry).withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", F.explode(F.arrays_zip("grams", "ns")).alias("g")).select("_row", F.col("g.grams").alias("gram"), F.col("g.ns").alias("n"))
    sums = each.join(p, "gram").groupBy("_row").agg(F.sum("n").alias("signs"), F.sum(F.col("n") * F.col("log_p")).alias("log_p"))
    zero = F.lit(0).cast("long")
    return rows.select("_row", id_col, *carry).join(sums, "_row", "left").select(id_col, *carry, F.coalesce("signs", zero).alias("signs"), F.coalesce("log_p", zero).alias("log_p"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
    quantile: float = 0.99, slack: float = 1.05, spread: float = 3.0, folds: int = 5,
) -> DataFrame:
    """One row per input row: (id, lang, signs, perplexity, threshold, keep).

    Trusted are the texts whose id a label calls 1. One of `folds` parts of them, by a hash of the id, is left out of the training; it gives the cut-off.
    A text is kept if its perplexity is at most `slack` times the `quantile` of the left-out texts' perplexities in its language, times
    exp(spread / sqrt(signs)), since short texts vary more; a null language is one of its own, and languages with under 20 such texts take the
    quantile of all.

    Null and empty texts have a null perplexity and are not kept; without left-out trusted text all others are. Texts of any length are read whole, block
    by block. A text at its cut-off is kept. Repeated rows are kept, repeated labels count once, labels without a row are ignored. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_good")).distinct()
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_of"))
    # Labels grow with the documents, so their join is the same merge at every size.
    left_out = F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(folds)) == 0
    both = plain.join(good.hint("merge"), F.col("_id") == F.col("_good"), "left").select("_id", "_text", "_good")
    rows = settle(perplexities(both, F.col("_good").isNotNull() & ~left_out, "_id", "_text", ("_of",), scored=plain))
    known = rows.where(left_out & F.col("perplexity").isNotNull()).join(good.hint("merge"), F.col("_id") == F.col("_good"), "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10_000) * slack
    overall = known.agg(cut.alias("cut")).first()["cut"]
    per = written(known.groupBy("_of").agg(cut.alias("_cut"), F.count(F.lit(1)).alias("_n")).where("_n >= 20").select(F.col("_of").alias("_lang"), "_cut"), "thresholds")
    threshold = F.coalesce("_cut", F.lit(overall if overall is not None else float("inf")).cast("double"))
    joined = rows.join(per, F.col("_of").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", threshold * F.exp(spread / F.sqrt(F.greatest("signs", F.lit(1)))))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return joined.select(F.col("_id").alias(id_col), F.col("_of").alias("lang"), "signs", "perplexity", "threshold", keep.alias("keep"))
