"""Exact dedup: group by a 128-bit content hash, then compare bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True, hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their bytes are, after lower-casing A-Z if `fold_case`. A null text counts as empty. Of equal texts the row with the
    smallest id stays (`keep="min"`), or the largest (`keep="max"`). Rows that repeat an id are one document: all rows that carry the id that stays
    are kept. A null id never stays where its group has another; in a group of null ids only, keep_id is null and all of its rows are kept.
    An empty table gives no rows. Other columns are ignored, whatever their names.

    How it scales: the first grouping moves one 128-bit hash per distinct text and map task. Only hashes met more than once go on; they are written
    as a table, so the planner knows its size and broadcasts it only below its own threshold. Their texts are grouped by (hash, bytes), with copies merged on the map side, so a text that a third of all rows share moves once per map task. Bytes that
    differ under one hash end in different groups. The groups are written as well, so that rows look theirs up by the hashes alone (no text moves) in a
    join with nothing else in its stage, which adaptive execution splits where one text is very frequent.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = (ascii_lower(text) if fold_case else text).alias("_norm")
    rows = docs.select(F.col(id_col).alias("_id"), norm).select("_id", "_norm", hash128(F.col("_norm")).alias("_hash"), F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"))

    repeated = written(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"), "repeated")
    keys = ["_hash", "text_sha256"]
    texts = rows.join(repeated, "_hash", "left_semi").groupBy(*keys, "_norm").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    # One row per compared text. Should different bytes ever share both hashes, the job fails rather than merge them.
    groups = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_texts"), F.first("_keep").alias("_keep"), F.first("_size").alias("_size"))
    groups = groups.select(*keys, "_keep", F.when(F.col("_texts") == 1, F.col("_size")).otherwise(F.raise_error(F.lit("different texts share MD5 and SHA-256")).cast("long")).alias("_size"))
    groups = written(groups, "groups")
    found = rows.select("_id", *keys).join(groups, keys, "left")
    keep_id = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )
