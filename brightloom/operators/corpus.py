"""Building a corpus: chunks, content dedup, change detection between generations, coverage; stored content and its savings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, sha256_text
from ..session import ship


def line_windows(text: str, lines: int = 80, chars: int = 6000, overlap: int = 10, long_overlap: int = 256) -> Iterator[tuple[int, int, int, int]]:
    """(first line, last line, start, end): overlapping windows of whole lines; a line over `chars` is cut into overlapping pieces by itself."""
    ends = [0]
    for line in text.splitlines(keepends=True):
        ends.append(ends[-1] + len(line))
    n, a = len(ends) - 1, 0
    while a < n:
        if ends[a + 1] - ends[a] > chars:
            at = ends[a]
            while True:
                yield a + 1, a + 1, at, min(at + chars, ends[a + 1])
                if at + chars >= ends[a + 1]:
                    break
                at += chars - long_overlap
            a += 1
            continue
        b = a + 1
        while b < n and b - a < lines and ends[b + 1] - ends[a] <= chars:
            b += 1
        yield a + 1, b, ends[a], ends[b]
        if b >= n:
            break
        a = max(a + 1, b - overlap)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, start_line, end_line, start_char, end_char, sha256) of each whole text's windows; empty and null texts have none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *w, hashlib.sha256(t[w[2] : w[3]].encode("utf-8", "surrogatepass")).hexdigest()) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1]) for k, w in enumerate(line_windows(t or ""))]
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "start_line", "end_line", "start_char", "end_char", "sha256"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ordinal long, start_line long, end_line long, start_char long, end_char long, sha256 string"
    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).mapInPandas(run, schema)


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, start_char, n_chars): the lines of each text with their places."""
    cut = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "_l"))
    before = F.sum(F.length("_l") + 1).over(Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return cut.select(id_col, F.col("line").cast("long").alias("line"), F.coalesce(before, F.lit(0)).cast("long").alias("start_char"), F.length("_l").cast("long").alias("n_chars"))


def distinct_contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert-if-absent by content: a row per distinct text with its first id and how often it was reused."""
    return docs.groupBy(sha256_text(F.col(text_col)).alias("sha256")).agg(F.min(id_col).alias("first_id"), (F.count(F.lit(1)) - 1).alias("reused"))


def changes(stored: DataFrame, wanted: DataFrame, key: str = "path", content: str = "sha256") -> DataFrame:
    """(key, change): added, removed, changed or unchanged, by a full outer join of two generations."""
    s, w = (df.select(F.col(key).alias("_k"), F.col(content).alias("_c"), F.lit(True).alias("_in")).alias(a) for df, a in ((stored, "s"), (wanted, "w")))
    both = s.join(w, F.col("s._k") == F.col("w._k"), "full_outer")
    change = F.when(F.col("s._in").isNull(), "added").when(F.col("w._in").isNull(), "removed").when(F.col("s._c").eqNullSafe(F.col("w._c")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("s._k", "w._k").alias(key), change.alias("change"))


def coverage(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents, and those that have a vector."""
    v = vectors.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("_v"))
    return docs.select("doc_id").join(v, "doc_id", "left").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.when(F.col("_v") == 1, F.col("doc_id"))).alias("covered"))


def missing(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def stored_sizes(files: DataFrame, blobs: DataFrame, *by: str) -> DataFrame:
    """Logical bytes of all references, bytes of the distinct contents, and what dedup saves. files: (by..., blob); blobs: (blob, size)."""
    per = files.groupBy(*by, "blob").agg(F.count(F.lit(1)).alias("n")).join(blobs.select("blob", "size"), "blob")
    total = per.groupBy(*by).agg(F.sum("n").cast("long").alias("files"), F.count(F.lit(1)).alias("blobs"), F.round(F.sum(F.col("n") * F.col("size")), 2).alias("logical"), F.round(F.sum("size"), 2).alias("physical"))
    return total.withColumn("saved", ratio(F.col("logical") - F.col("physical"), F.col("logical")))


def tier_winners(measured: DataFrame, by: str, key: str) -> DataFrame:
    """The best codec row of each group for HOT (fastest), WARM (fast for its size) and COLD (smallest); ties by key. measured: speed and size."""
    n = measured
    rules = {"HOT": [F.desc("speed"), F.asc("size"), F.asc(key)], "WARM": [F.desc(F.col("speed") / F.nullif(F.col("size"), F.lit(0))), F.asc(key)], "COLD": [F.asc("size"), F.desc("speed"), F.asc(key)]}
    for tier, order in rules.items():
        n = n.withColumn(tier, F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1)
    won = n.select(by, key, F.explode(F.array(*[F.when(F.col(t), F.lit(t)) for t in rules])).alias("tier"))
    return won.where("tier IS NOT NULL")


def group_digests(df: DataFrame, by: str, row: str) -> DataFrame:
    """Order-independent digest of each group's rows: their number, and MD5 over sums of two 60-bit lanes of each row's MD5, which combine before the shuffle."""
    lane = lambda at: F.sum(F.conv(F.substring(F.md5(row), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.md5(F.concat_ws("|", lane(1), lane(17))).alias("digest"))
