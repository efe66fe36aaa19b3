"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_bits, hash_range, running_sum, settle, word_count, written

#: The golden ratio's fraction: multiples of it, modulo 1, spread evenly at every length.
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target) from (source, size), a row per source.

    Sources by code point, null last, take the weights in turn and share `share` times all sizes; a target stops at `limit` times its source's
    size and the excess is shared again. The fixed point is target = min(limit * size, level * weight); the level follows from running sums over
    the sources, of which there is one row each.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("rank") % len(weights) + 1))
    per = per.withColumn("cap", limit * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.least(F.lit(share), F.lit(limit)) * F.sum("source_size").over(every) - capped) / open_weight)
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"], F.max("ratio").over(every))
    return per.withColumn("_level", level).select("source", "rank", "source_size", F.least("cap", F.col("_level") * F.col("weight")).alias("target"))


def slot_schedule(sources: DataFrame, block: int) -> DataFrame:
    """(rank, slot, turn): the mix's slots; slot t falls to the source in whose share of (0, 1) the t-th golden-ratio point lies.

    `turn` numbers a source's slots from 0. A source that is to give words but is met by no point gets one slot after the others.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("take").alias("n")).first()["n"] or 0
    slots, give = -(-total // block), sources.where("take > 0")
    cells, upto = 1024, Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ends = give.select("rank", (F.sum("take").over(upto) / F.lit(float(max(total, 1)))).alias("hi"))
    ends = ends.select("rank", "hi", F.lag("hi", 1, 0.0).over(Window.orderBy("rank")).alias("lo"))
    ends = ends.select("*", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(0.5D + id * {GOLDEN}D) % 1D").alias("u"))
    met = points.withColumn("cell", F.floor(F.col("u") * cells)).join(ends, "cell").where("u >= lo AND u < hi").select("rank", "slot")
    part = 1 << (fold_bits(slots) if slots else 1)
    met = running_sum(met.select("*", F.expr(f"CAST(slot DIV {part} AS INT)").alias("part"), F.lit(1).cast("long").alias("one")), ["rank"], "part", [F.col("slot")], "one", "turn")
    met = settle(met.select("rank", "slot", "turn"))
    missed = give.join(met.select("rank").distinct(), "rank", "left_anti").select("rank", (F.lit(slots) + F.col("rank")).alias("slot"), F.lit(0).cast("long").alias("turn"))
    return met.unionByName(missed)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = 1024, seed: int = 7, carry: tuple[str, ...] = (),
) -> DataFrame:
    """The mix in pieces: (id, carried columns, row, size, source_size, target, slot, pass, start, end).

    Documents of a source lie on a line of words in an order shuffled by hash. The line, repeated, is cut into as many equal blocks as the source
    has slots; together they hold its target, rounded to words. A piece says that slot `slot` holds the words `start` to `end` (exclusive) of the
    document, in the given pass over the source. Sorting by (slot, pass, ...) gives the mix. A document of which nothing is taken has one row
    with null slot. `row` tells apart rows that repeat an id. Null texts have size 0; a null source is a source. An empty table gives no rows.

    Texts of any length are counted whole. Rows with equal hashes lie by id, then size; equal rows are interchangeable. Columns that are not carried are ignored,
    whatever their names; carried ones may not have a name of the result.

    The order depends on ids, sizes and `seed` only, so reruns agree. A source with a third of all rows is cut into hash ranges for the running
    sums, and its blocks join by (source, turn), which spreads evenly.
    """
    sized = settle(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *carry))
    sources = source_targets(sized, weights, share, limit).withColumn("take", F.least(F.round("target").cast("long"), (F.lit(limit) * F.col("source_size")).cast("long")))
    sources = written(sources, "sources")
    schedule = slot_schedule(sources, block)
    given = schedule.groupBy("rank").agg(F.count(F.lit(1)).alias("turns"))
    sources = written(sources.join(given, "rank", "left").withColumn("turns", F.coalesce("turns", F.lit(1).cast("long"))), "sources")
    plan = sources.select("source", "rank", "source_size", "target", "take", F.expr("greatest(take DIV turns, 1)").alias("base"), F.expr("take % turns").alias("extra"))

    bits = fold_bits(sized.count())
    rows = sized.withColumn("key", F.xxhash64(F.lit(seed), "_id")).withColumn("part", hash_range(F.col("key"), bits))
    rows = rows.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    rows = running_sum(rows, ["rank"], "part", [F.col("key"), F.col("_id"), F.col("size")], "size", "at")

    passes = F.when((F.col("at") < F.col("take")) & (F.col("size") > 0), F.sequence(F.lit(0).cast("long"), F.expr("(take - 1 - at) DIV source_size")))
    rows = rows.select("*", F.explode_outer(passes).alias("pass"))
    rows = rows.withColumn("x0", F.expr("pass * source_size + at")).withColumn("x1", F.least(F.expr("x0 + size"), "take"))
    turn = lambda x: f"(CASE WHEN {x} < extra * (base + 1) THEN {x} DIV (base + 1) ELSE extra + ({x} - extra * (base + 1)) DIV base END)"
    rows = rows.select("*", F.explode_outer(F.when(F.col("x0") < F.col("x1"), F.sequence(F.expr(turn("x0")), F.expr(turn("(x1 - 1)"))))).alias("turn"))
    rows = rows.withColumn("b0", F.expr("turn * base + least(turn, extra)")).withColumn("b1", F.expr("(turn + 1) * base + least(turn + 1, extra)"))
    mixed = rows.join(schedule, ["rank", "turn"], "left")
    return mixed.select(
        F.col("_id").alias(id_col), *carry, F.concat_ws("-", "rank", "part", "at_row").alias("row"), "size", "source_size", "target", "slot", "pass",
        F.expr("greatest(x0, b0) - x0").alias("start"), F.expr("least(x1, b1) - x0").alias("end"),
    )


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the mix: (id, size, source_size, target, taken), taken in words with repeats; all cases as in mix()."""
    words = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("end") - F.col("start"))), F.lit(0)).cast("long")
    return mixed.groupBy("row", id_col, "size", "source_size", "target").agg(words.alias("taken")).drop("row")
