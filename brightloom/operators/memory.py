"""Durable memory with history, context deltas, and comparisons between sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that each state may change to.
TRANSITIONS = {
    "OBSERVATION": ("INFERRED", "PROPOSED", "CONFIRMED", "DEPRECATED"), "INFERRED": ("PROPOSED", "CONFIRMED", "DEPRECATED"),
    "PROPOSED": ("CONFIRMED", "DEPRECATED"), "CONFIRMED": ("DEPRECATED",), "CANONICAL": ("DEPRECATED",),
}


def may_change(old: Column, new: Column) -> Column:
    return F.array_contains(F.coalesce(F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[old], F.array()), new)


def transitions(history: DataFrame, key: str, version: str, state: str) -> DataFrame:
    """Each version with the state before it and whether the change is allowed; a first version always is, and so is no change."""
    old = F.lag(state).over(Window.partitionBy(key).orderBy(version))
    h = history.select(key, version, F.col(state).alias("state"), old.alias("before"))
    return h.withColumn("allowed", F.col("before").isNull() | (F.col("before") == F.col("state")) | F.coalesce(may_change(F.col("before"), F.col("state")), F.lit(False)))


def current(history: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """The latest version of each record, and the number of versions."""
    return history.groupBy(key).agg(F.max(version).alias("version"), *[F.max_by(c, version).alias(c) for c in columns], F.count(F.lit(1)).alias("versions"))


def first_occurrences(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows that are the first with their key; null keys are a key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def map_diff(old: Column, new: Column) -> Column:
    """Operations that turn one map of JSON values into another: removals, then additions, then replacements, each by key."""
    keys = lambda m: F.array_sort(F.map_keys(m))
    op = lambda name, ks, of: F.transform(ks, lambda k: F.struct(F.lit(name).alias("op"), F.concat(F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("path"), of(k).alias("value")))
    both = F.filter(F.array_intersect(keys(new), keys(old)), lambda k: ~old[k].eqNullSafe(new[k]))
    none = lambda k: F.lit(None).cast("string")
    return F.concat(op("remove", F.array_except(keys(old), keys(new)), none), op("add", F.array_except(keys(new), keys(old)), lambda k: new[k]), op("replace", both, lambda k: new[k]))


def successors(records: DataFrame, key: str = "memory_id", replaces: str = "supersedes") -> DataFrame:
    """(key, successor): for each record the newest one that replaces it, ties by id; null without one. records: key, replaces, created_at."""
    newest = records.where(F.col(replaces).isNotNull()).groupBy(F.col(replaces).alias("_k")).agg(F.max_by(key, F.struct("created_at", key)).alias("successor"))
    return records.select(key).join(newest, F.col(key) == F.col("_k"), "left").select(key, "successor")


def with_overrides(rows: DataFrame, live: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows with the live values where there are any; live rows without a row of their own are added."""
    both = rows.select(key, *values).join(live.select(key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_live")), key, "full_outer")
    return both.select(key, *[F.coalesce(f"_{v}", v).alias(v) for v in values], F.coalesce("_live", F.lit(False)).alias("live"))


def digest_check(admitted: DataFrame, found: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, result): ok or mismatch for what was admitted, missing if it is not found, unexpected for what else is found."""
    a = admitted.select(F.col(key).alias("_a"), F.col(digest).alias("_x"))
    b = found.select(F.col(key).alias("_b"), F.col(digest).alias("_y"))
    result = F.when(F.col("_a").isNull(), "unexpected").when(F.col("_b").isNull(), "missing").when(F.col("_x").eqNullSafe(F.col("_y")), "ok").otherwise("mismatch")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), result.alias("result"))


def rows_as_json(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, rows): each group's rows as one JSON array, ordered by their columns. A group becomes one value, so this is for registries, not for events."""
    return df.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("rows"))


def clean_tags(tags: Column, most: int = 32, longest: int = 64) -> Column:
    """Tags trimmed, in order; null if there are too many, or one is blank or too long."""
    trimmed = F.transform(tags, lambda t: F.trim(t))
    return F.when((F.size(trimmed) <= most) & F.forall(trimmed, lambda t: (F.length(t) > 0) & (F.length(t) <= longest)), trimmed)
