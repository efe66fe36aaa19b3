"""Document fingerprints: a homomorphic multiset hash of paragraphs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Lanes of the identity part (64 bits each) and of the likeness part (32 bits each).
EXACT, LIKE = 8, 128
AT_ONCE = 1 << 15
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Words(dict):
    """Hashes of words, kept for the next time; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


class Multiset:
    """Sum of the wide vectors of a text's paragraphs (its lines that are not blank).

    A paragraph's vector has EXACT lanes from its BLAKE2b digest, added modulo 2^64, and LIKE lanes in which each of its three-word shingles adds
    1 or -1, added modulo 2^32. The order of paragraphs does not matter, and adding or taking away a paragraph needs no other text.
    """

    def __init__(self, text: str = "") -> None:
        self.exact, self.like = np.zeros(EXACT, np.uint64), np.zeros(LIKE, np.int64)
        self.add(text)

    def add(self, text: str, sign: int = 1) -> Multiset:
        """Add a text's paragraphs, or take them away with sign -1."""
        held: list[str] = []
        for paragraph in text.split("\n"):
            words = paragraph.split()
            if not words:
                continue
            lanes = np.frombuffer(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass")).digest(), np.uint64)
            self.exact = self.exact + lanes if sign > 0 else self.exact - lanes
            held += [*words, "", ""]
            if len(held) > AT_ONCE:
                self._shingles(held, sign)
                held = []
        self._shingles(held, sign)
        return self

    def _shingles(self, words: list[str], sign: int) -> None:
        """Every word starts a shingle of three; "" stands for what is missing at a paragraph's end."""
        for at in range(0, len(words) - 2, AT_ONCE):
            w = np.fromiter(map(_words.__getitem__, words[at : at + AT_ONCE + 2]), np.uint64)
            real = np.fromiter(map(bool, words[at : at + w.size - 2]), bool)
            x = (w[:-2] * _P[0] + w[1:-1] * _P[1] + w[2:] * _P[2])[real]
            x ^= x >> np.uint64(29)
            x *= _P[3]
            x ^= x >> np.uint64(32)
            y = x * _P[4]
            y ^= y >> np.uint64(31)
            y *= _P[0]
            ones = [np.unpackbits(z.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64) for z in (x, y)]
            self.like += sign * (2 * np.concatenate(ones) - x.size)

    def hex(self) -> str:
        return self.exact.astype(">u8").tobytes().hex() + (self.like & 0xFFFFFFFF).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Cosine of the likeness lanes of two fingerprints, at least 0; 1 for equal fingerprints. Its standard error is about 1 / sqrt(LIKE).

    A lane wraps only beyond 2^31 shingles, which no text of 2 GB has.
    """
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16 * EXACT :]), ">i4").astype(float) for s in (a, b))
    n = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / n)) if n else 0.0


def edited_text(text: str, following: str) -> str:
    """The last third of the text replaced by as many code points from the start of the next one, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def id_ranges(docs: DataFrame, id_col: str, n: int) -> list:
    """n - 1 ids that split all ids into ranges of about the same number of rows, ascending; an id that fills ranges comes repeatedly. From a sketch, so no id list is gathered."""
    found = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10 * n).alias("p")).first()["p"] if n > 1 else None
    return sorted(found or [])


def dealt_parts(docs: DataFrame, id_col: str, n: int, least: int = 1000) -> Column:
    """The range of a row's id and, for ids that fill ranges of their own (or null), the part of that range by the hash of its text (`tie`).

    Parts follow the order of edit_fingerprints(): ascending parts are ascending ids, null before all, and ascending ties within an id. A text that fills
    parts itself is dealt at random among them, since rows that are equal in id and text may stand in any order (if ranges have `least` rows, so that none stays empty).
    """
    splits = id_ranges(docs, id_col, n)
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(id_col).isNull()).alias("none")).first()
    heavy: dict = {i: k for i, k in Counter(splits).items() if k > 1}
    if n > 1 and counts["none"] * n > counts["n"]:
        heavy[None] = math.ceil(counts["none"] * n / counts["n"])
    edges = sorted(set(splits))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("id"))) + 1 if edges else F.lit(1)
    part = F.when(F.col("id").isNull(), F.lit(0)).otherwise(part).cast("long")
    inner = F.lit(0).cast("long")
    for i, k in heavy.items():
        mine = docs.where(F.col(id_col).isNull() if i is None else F.col(id_col) == i)
        ties = sorted(mine.agg(F.percentile_approx(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), [j / k for j in range(1, k)], 10 * k).alias("p")).first()["p"] or []) if k > 1 else []
        at = F.lit(0).cast("long")
        for tie, m in Counter(ties).items():
            above = F.col("tie") > tie
            at = at + F.when(above, F.lit(m)).when(F.col("tie") == tie, F.floor(F.rand(7) * m) if m > 1 and counts["n"] >= least * n else F.lit(0)).otherwise(0).cast("long")
        inner = F.when(F.col("id").isNull() if i is None else F.col("id") == i, at).otherwise(inner)
    # An id that fills ranges is the last of its range: what is below it comes first.
    own = F.lit(0).cast("long")
    for i in heavy:
        if i is not None:
            own = F.when(F.col("id") == i, F.lit(1)).otherwise(own)
    return (part * 2 + own) * (1 << 20) + inner


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Rows follow one another by descending id (null ids last), rows with the same id by the hash of their text; after the last comes the first.
    Each text is fingerprinted, and so is its edited text (see edited_text) with the next row's text. Null texts count as empty and have
    the fingerprint of no paragraph; a single row is its own next. Repeated rows are kept and follow one another. Texts of any length are read whole. An
    empty table gives no rows. Ids are numbers. Other columns are ignored, whatever their names.

    Texts are shuffled once: rows are dealt by ranges of ids, each range also gets a copy of the first row of the range that follows (one row per
    range), and neighbours meet as each sorted range is read. Rows of one id (or of none) that fill ranges are dealt by their texts. No task or driver
    sees more than one range.
    """
    spark = docs.sparkSession
    ship(spark)
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("part", dealt_parts(docs, id_col, n)).withColumn("first", F.lit(False))
    firsts = sorted(rows.groupBy("part").agg(F.max(F.struct("id", "tie")).alias("m")).collect(), reverse=True)
    halo = [(a["part"], b["m"]["id"], b["m"]["tie"]) for a, b in zip(firsts, [*firsts[1:], *firsts[:1]])]
    schema = T.StructType([T.StructField("to", T.LongType()), T.StructField("_id", id_type), T.StructField("_tie", T.LongType())])
    edges = F.broadcast(spark.createDataFrame(halo, schema))  # one row per range
    copies = rows.join(edges, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    copies = copies.groupBy("id", "tie", F.col("to").alias("part")).agg(F.any_value("text").alias("text"))  # one of rows that are equal
    copies = copies.select("id", "text", "tie", "part", F.lit(True).alias("first"))
    out = T.StructType([T.StructField(id_col, id_type)]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, text, fingerprint of the row before
        for b in batches:
            made = []
            for part, first, i, t in zip(*(b.column(k) for k in range(4))):
                part, first, t = part.as_py(), first.as_py(), t.as_py()
                mark = Multiset(t).hex() if held or not first else ""
                if held and held[0] == part:
                    changed = edited_text(held[2], t)
                    edited = Multiset(changed).hex()
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    made.append((held[1], len(held[2]), sha, held[3], edited, likeness(held[3], edited), likeness(held[3], mark)))
                held = None if first else (part, i.as_py(), t, mark)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], arrow.field(k).type) for k in range(len(arrow))], schema=arrow)

    dealt = rows.unionByName(copies).repartition("part").sortWithinPartitions(F.col("part"), F.col("first"), F.col("id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("part", "first", "id", "text").mapInArrow(run, out)
