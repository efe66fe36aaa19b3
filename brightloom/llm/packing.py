"""Packing: optimal length buckets by dynamic programming, token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bits, hash_range, running_sum, settle, word_count, written


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` length ranges that minimise padding, where every sequence is padded to its range's end.

    Exact: for each number of ranges, the best last cut moves right with the end (the costs satisfy the quadrangle inequality), so divide and
    conquer finds all cuts in O(n log n).
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(c)])
    words = np.concatenate([[0.0], np.cumsum(c * x.astype(float))])
    cost = x * (total[1:] - 0.0) - words[1:]  # one range
    cuts: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        before, new, cut = cost, np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            # the last range holds lengths i+1..mid, the ranges before it end at i; -1: the range starts at the first length
            i = np.arange(a, min(b, mid - 1) + 1) if mid else np.empty(0, np.int64)
            value = before[i] + x[mid] * (total[mid + 1] - total[i + 1]) - (words[mid + 1] - words[i + 1])
            k = int(np.argmin(value)) if i.size else -1
            best = int(i[k]) if i.size else a
            whole = x[mid] * total[mid + 1] - words[mid + 1]
            new[mid], cut[mid] = (value[k], best) if i.size and value[k] < whole else (whole, -1)
            todo += [(lo, mid - 1, a, best), (mid + 1, hi, best, b)]
        cost = new
        cuts.append(cut)
    ends, at = [n - 1], n - 1
    for cut in reversed(cuts):
        at = int(cut[at])
        if at < 0:
            break
        ends.append(at)
    return [int(x[i]) for i in reversed(ends)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, buckets: int = 16, budget: int = 32768, longest: int = 8192, seed: int = 7) -> DataFrame:
    """One row per piece: (id, piece, start, n_tokens, bucket, bucket_len, batch, slot, padding).

    Lengths are words, or `length_col`. A document longer than `longest` is cut into pieces of `longest` and a rest; nothing is dropped. The
    histogram of piece lengths (at most longest + 1 rows, so it may be collected) gives the bucket ends with least padding. Inside a bucket,
    pieces shuffled by hash fill batches of floor(budget / bucket_len) slots, one at least. Null or empty texts and null or negative lengths
    give one piece of length 0. Repeated rows, also those with a null id, are pieces of their own, shuffled each by itself. Texts of any length are
    counted whole. Equal lengths are one row of the histogram. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    n = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)) if length_col else word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), n.cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(n - 1, 0) DIV {longest}"))).alias("piece"))
    rows = settle(rows.select("_id", "row", "piece", (F.col("piece") * longest).alias("start"), F.least(F.expr(f"n - piece * {longest}"), F.lit(longest)).alias("n_tokens")))
    seen = [(r["n_tokens"], r["n"]) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    ends = best_buckets([x for x, _ in seen], [c for _, c in seen], buckets) or [0]
    bucket = sum(((F.col("n_tokens") > e).cast("int") for e in ends), F.lit(0))
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1))
    # Rows that share an id are told apart by their place, so that copies do not lie in one batch.
    shared = written(rows.where("piece = 0").groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("_id").alias("_shared"), F.lit(True).alias("_again")), "shared")
    rows = rows.join(shared, F.col("_id").eqNullSafe(F.col("_shared")), "left").withColumn("row", F.when(F.col("_again"), F.col("row"))).drop("_shared", "_again")
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "_id", "piece", "row")).withColumn("part", hash_range(F.col("key"), fold_bits(sum(c for _, c in seen)))).withColumn("one", F.lit(1).cast("long"))
    rows = running_sum(rows, ["bucket"], "part", [F.col("key"), F.col("_id"), F.col("row"), F.col("n_tokens")], "one", "at")
    room = F.expr(f"greatest({budget} DIV greatest(bucket_len, 1), 1)")
    return rows.withColumn("room", room).select(
        F.col("_id").alias(id_col), "piece", "start", "n_tokens", "bucket", "bucket_len", F.expr("at DIV room").alias("batch"),
        F.expr("at % room").cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
