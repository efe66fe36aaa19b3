"""Progressive disclosure: what of a task's context each level shows, and the lowest level that suffices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most items of each kind by level 0 to 5, and the most characters of an excerpt.
BOUNDS = {"module": (0, 5, 5, 5, 5, 5), "symbol": (0, 0, 8, 8, 8, 8), "test": (0, 0, 8, 8, 8, 8), "excerpt": (0, 0, 0, 5, 5, 5), "file": (0, 0, 0, 0, 2, 2), "inventory": (0, 0, 0, 0, 0, 20)}
EXCERPT_CHARS = 800


def bound(kind: Column, level: Column) -> Column:
    """The most items of a kind at a level; 0 for a kind that is unknown."""
    rows = F.create_map(*[x for k, v in BOUNDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(F.try_element_at(rows, kind), level + 1), F.lit(0))


def starting_level(requested: Column, names_path: Column, names_symbol: Column, needs_text: Column) -> Column:
    """The level asked for; else the one for the most specific thing a task names: whole texts, files, symbols; else 0."""
    return F.coalesce(requested, F.when(needs_text, 4).when(names_path, 3).when(names_symbol, 2).otherwise(0))


def final_level(start: Column, sufficient: list[Column]) -> Column:
    """The first level from `start` on whose evidence suffices (conditions by level 0 to 5); the last level if none does."""
    tries = [F.when((start <= n) & F.coalesce(ok, F.lit(False)), n) for n, ok in enumerate(sufficient)]
    return F.coalesce(*tries, F.lit(len(sufficient) - 1))


def disclosed(items: DataFrame, levels: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, kind, rank, text, cut) of the items a task's level shows, best first; excerpts are cut. items: task, kind, order, text; levels: task, level."""
    n = F.row_number().over(Window.partitionBy(task, "kind").orderBy("order"))
    shown = items.select(task, "kind", "order", "text").join(levels.select(task, "level"), task).withColumn("rank", n.cast("long")).where(F.col("rank") <= bound(F.col("kind"), F.col("level")))
    long = (F.col("kind") == "excerpt") & (F.length("text") > EXCERPT_CHARS)
    return shown.select(task, "kind", "rank", F.when(long, F.left("text", F.lit(EXCERPT_CHARS))).otherwise(F.col("text")).alias("text"), F.coalesce(long, F.lit(False)).alias("cut"))


def truncated(items: DataFrame, levels: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, truncated): whether a level leaves out or cuts anything of a kind that it shows."""
    n = items.groupBy(task).agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in BOUNDS], F.max(F.when(F.col("kind") == "excerpt", F.length("text"))).alias("_longest"))
    limit = lambda k: bound(F.lit(k), F.col("level"))
    over = reduce(Column.__or__, [(limit(k) > 0) & (F.coalesce(f"_{k}", F.lit(0)) > limit(k)) for k in BOUNDS])
    return levels.select(task, "level").join(n, task, "left").select(task, (over | ((limit("excerpt") > 0) & (F.coalesce("_longest", F.lit(0)) > EXCERPT_CHARS))).alias("truncated"))
