"""Telemetry: pages by cursor, runs folded from events, metrics with provenance, running rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import provenance_name, provenance_rank

#: Event types that end a run.
TERMINAL = ("run.completed", "run.failed")


def page(events: DataFrame, cursor: int | None = None, limit: int = 100) -> DataFrame:
    """The next `limit` events after a cursor (None: from the start), and whether there are more: one row more than asked for is looked at, nothing is counted."""
    ahead = (events if cursor is None else events.where(F.col("ordering_id") > cursor)).orderBy("ordering_id").limit(limit + 1)  # the page is the feature
    ahead = ahead.withColumn("_n", F.row_number().over(Window.orderBy("ordering_id")))
    more = F.max("_n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit
    return ahead.withColumn("has_more", more).where(F.col("_n") <= limit).drop("_n")


def newest(events: DataFrame, limit: int = 100) -> DataFrame:
    """The newest events, in ascending order."""
    return events.orderBy(F.desc("ordering_id")).limit(limit).orderBy("ordering_id")


def deduplicated(events: DataFrame, key: str = "emission_key") -> DataFrame:
    """Idempotent append: of equal events under a key the first stays; a key with different contents is an error."""
    same = events.groupBy("project_id", key).agg(F.count_distinct("content").alias("n"), F.min("ordering_id").alias("ordering_id"), F.count(F.lit(1)).alias("copies"))
    kept = F.when(F.col("n") == 1, F.col("ordering_id")).otherwise(F.raise_error(F.lit("an emission key has different contents")).cast("long"))
    return same.select("project_id", key, kept.alias("ordering_id"), "copies")


def runs(events: DataFrame) -> DataFrame:
    """A row per run: counts, first and last event, last terminal event, status."""
    kind, at = F.col("event_type"), F.col("ordering_id")
    ended = F.max_by(F.when(kind.isin(*TERMINAL), kind), F.when(kind.isin(*TERMINAL), at))
    folded = events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min_by("occurred_at", at).alias("first_at"), F.max_by("occurred_at", at).alias("last_at"),
        F.max_by(kind, at).alias("last_type"), F.bool_or(kind == "executor.started").alias("started"), ended.alias("terminal"), F.max(at).alias("last_ordering"),
    )
    status = F.when(F.col("terminal") == "run.completed", "COMPLETED").when(F.col("terminal") == "run.failed", "FAILED").when(F.col("started"), "ACTIVE").otherwise("OBSERVED")
    return folded.withColumn("status", status)


def test_status(events: DataFrame) -> DataFrame:
    """A row per run: tests started, passed and failed, and the status that matters most."""
    kind = F.col("event_type")
    n = events.groupBy("run_id").agg(
        F.count_if(kind == "executor.started").alias("started"), F.count_if(kind == "run.completed").alias("passed"), F.count_if(kind == "run.failed").alias("failed")
    )
    status = F.when(F.col("failed") > 0, "FAILED").when(F.col("passed") > 0, "PASSED").when(F.col("started") > F.col("passed") + F.col("failed"), "RUNNING").otherwise("UNRECORDED")
    return n.withColumn("status", status)


def selected(metrics: DataFrame) -> DataFrame:
    """Of each run's values for a key the best: by provenance, then time, then order. Runs that are null stand for their event.

    A maximum over structs, which combines before the shuffle, so a run with a third of all rows is no hot task.
    """
    who = F.coalesce(F.col("run_id").cast("string"), F.concat(F.lit("event:"), F.col("ordering_id").cast("string")))
    order = F.struct(provenance_rank(F.col("provenance")), "occurred_at", "ordering_id")
    best = metrics.groupBy(who.alias("who"), "key").agg(F.max_by(F.struct(*metrics.columns), order).alias("_best"))
    return best.select("_best.*", "who")


def summed(metrics: DataFrame, *by: str) -> DataFrame:
    """Sums that keep provenance: nulls are skipped, the least certain part names the sum, no part at all is UNAVAILABLE and null."""
    rank = F.when(F.col("value").isNotNull(), provenance_rank(F.col("provenance")))
    total = metrics.groupBy(*by).agg(F.sum("value").alias("total"), F.min(rank).alias("_rank"))
    return total.select(*by, "total", provenance_name(F.col("_rank")).alias("provenance"))


def fresh_tokens(metrics: DataFrame) -> DataFrame:
    """Per run: max(input - cached, 0) where both are known and neither is UNKNOWN."""
    of = lambda key, c: F.max(F.when(F.col("key") == key, F.col(c)))
    per = selected(metrics).withColumn("rank", provenance_rank(F.col("provenance"))).groupBy("run_id").agg(
        of("input", "value").alias("input"), of("cached", "value").alias("cached"), of("input", "rank").alias("ri"), of("cached", "rank").alias("rc")
    )
    known = (F.col("ri") > 1) & (F.col("rc") > 1)
    return per.select("run_id", F.when(known, F.greatest(F.col("input") - F.col("cached"), F.lit(0.0))).alias("fresh"), provenance_name(F.when(known, F.least("ri", "rc"))).alias("provenance"))


def cache_rates(events: DataFrame, *by: str) -> DataFrame:
    """Hits, misses and their rate; with neither the rate is null, not 0."""
    kind = F.col("event_type")
    n = events.groupBy(*by).agg(F.count_if(kind == "cache.hit").alias("hits"), F.count_if(kind == "cache.miss").alias("misses"))
    return n.withColumn("rate", F.round(F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), 6))


def running(events: DataFrame, good: Column, bad: Column, by: str = "run_id", large: int = 1 << 20) -> DataFrame:
    """A point per event once there is an outcome: the share of good ones so far within its run.

    A run of more than `large` events is cut into as many ranges of ordering ids as it has times so many; the ranges' totals are accumulated first, one row
    each, then each range by itself, so no run is one task. All other runs are accumulated whole; only large ones have rows in what is joined.
    """
    n = events.select(by, "ordering_id", good.cast("long").alias("_g"), bad.cast("long").alias("_b"))
    per = n.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"), F.min("ordering_id").alias("_lo"), F.max("ordering_id").alias("_hi")).where(F.col("_n") > large)
    n = n.join(per, F.col(by).eqNullSafe(F.col("_by")), "left")
    share = (F.col("ordering_id") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)
    n = n.select(by, "ordering_id", "_g", "_b", F.floor(share * F.ceil(F.col("_n") / large)).cast("int").alias("_p"))
    sums = n.where("_p IS NOT NULL").groupBy(F.col(by).alias("_by"), F.col("_p").alias("_sp")).agg(F.sum("_g").alias("_g"), F.sum("_b").alias("_b"))
    before = Window.partitionBy("_by").orderBy("_sp").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    sums = sums.select("_by", "_sp", zero("_g", before).alias("_g0"), zero("_b", before).alias("_b0"))
    n = n.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_sp")), "left")
    upto = Window.partitionBy(by, "_p").orderBy("ordering_id").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda c: F.coalesce(f"{c}0", F.lit(0).cast("long")) + zero(c, upto)
    n = n.select(by, "ordering_id", so_far("_g").alias("good"), so_far("_b").alias("bad"))
    return n.where("good + bad > 0").withColumn("rate", F.round(F.col("good") / (F.col("good") + F.col("bad")), 6))


def spikes(events: DataFrame, factor: float = 2.0, least: int = 3, by: str = "run_id") -> DataFrame:
    """Runs whose latest value is over `factor` times the mean of all before it, with `least` values at least. Sums only: no run meets in one task."""
    per = events.where("value IS NOT NULL").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.max_by("value", "ordering_id").alias("latest"))
    per = per.withColumn("before", (F.col("s") - F.col("latest")) / F.nullif(F.col("n") - 1, F.lit(0)))
    return per.select(by, "n", "latest", F.round("before", 6).alias("before"), F.coalesce((F.col("n") >= least) & (F.col("latest") > factor * F.col("before")), F.lit(False)).alias("spike"))


def last_state(events: DataFrame, kinds: list[str], by: str = "run_id") -> DataFrame:
    """The last of the given kinds that each run has seen."""
    return events.where(F.col("event_type").isin(*kinds)).groupBy(by).agg(F.max_by("event_type", "ordering_id").alias("state"), F.max("ordering_id").alias("as_of"))


def history(events: DataFrame, points: int = 20, by: str = "run_id") -> DataFrame:
    """The last `points` values of each run and type, numbered from the newest."""
    w = Window.partitionBy(by, "event_type").orderBy(F.desc("ordering_id"))
    return events.select(by, "event_type", "ordering_id", "value", F.row_number().over(w).cast("long").alias("back")).where(F.col("back") <= points)
