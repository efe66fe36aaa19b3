"""A task's governing sections within their budget, its query, what may be cached; the whole state of projects as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of governing excerpts and of a query.
BUDGET, SLOTS, EXCERPT_CHARS, QUERY_CHARS = 12000, 12, 1600, 512
#: States after which a result is not cached.
NOT_CACHED = ("RERANK_FALLBACK_PROVIDER_ERROR", "RERANK_FALLBACK_INVALID_RESPONSE", "RERANK_FALLBACK_NO_CANDIDATES")
PROVIDER_ERROR = "LEXICAL_FALLBACK_PROVIDER_ERROR"
#: States of memory records that are staged.
STAGED = ("OBSERVATION", "INFERRED", "PROPOSED", "CONFIRMED")


def derived_query(title: Column, text: Column, constraints: Column, criteria: Column) -> Column:
    """A task's query: the starts of its title, its text, its first two constraints and criteria, without blank parts, cut."""
    two = lambda xs: F.left(F.array_join(F.slice(xs, 1, 2), " "), F.lit(96))
    parts = [F.left(title, F.lit(128)), F.left(text, F.lit(192)), two(constraints), two(criteria)]
    parts = F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.left(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(QUERY_CHARS))


def cache_eligible(rerank_state: Column, hybrid_state: Column, reason: Column, results: Column) -> Column:
    """Whether a retrieval's outcome may be reused: it has results, and neither provider failed."""
    failed = rerank_state.isin(*NOT_CACHED) | (hybrid_state == PROVIDER_ERROR)
    return F.coalesce(~failed & (results > 0), F.lit(False)) & ~F.coalesce(reason == PROVIDER_ERROR, F.lit(False))


def governance(sections: DataFrame, kinds: tuple[str, ...], group: str = "task_id", budget: int = BUDGET, slots: int = SLOTS, most: int = EXCERPT_CHARS) -> DataFrame:
    """(group, state, order, kind, index, excerpt, truncated): the sections that govern a task, within `budget` characters and `slots` excerpts.

    sections: group, kind, index (place in its document), text, score. All sections of the first kind are required, in their order; of every later
    kind the best is; required ones take fair shares of what is left, the first kind's of what the later kinds leave to it. Then sections
    with a score above 0 follow by kind and score while slots and characters last. A group that lacks a kind (MISSING), or cannot
    hold what is required (UNSATISFIABLE), gives one row with that state. Missing texts and scores count as empty and 0.

    Sections past the slots are left out by rank before they are gathered, so a group's array is bounded whatever its documents hold.
    """
    later = len(kinds) - 1
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1
    score = F.coalesce("score", F.lit(0))
    text = F.coalesce("text", F.lit(""))
    rows = sections.select(group, "kind", "index", F.length(text).alias("_n"), F.left(text, F.lit(most)).alias("_text"), score.alias("_score"), place.alias("_place"))
    best = Window.partitionBy(group, "kind").orderBy(F.when(F.col("_place") == 0, 0).otherwise(-F.col("_score")), "index")
    near = rows.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= slots + 1)
    phase = F.when(F.col("_place") < 0, 3).when(F.col("_place") == 0, 0).when(F.col("_rank") == 1, 1).when(F.col("_score") > 0, 2).otherwise(3)
    item = F.struct(phase.alias("phase"), F.col("_place").alias("place"), F.col("_rank").alias("rank"), "kind", "index", F.col("_n").alias("n"), F.col("_text").alias("text"))
    g = near.groupBy(group).agg(F.array_sort(F.collect_list(F.when(phase < 3, item))).alias("x"))
    count = lambda p: F.size(F.filter("x", lambda x: x["phase"] == p))
    g = g.withColumn("_first", count(0)).withColumn("_must", F.col("_first") + count(1))
    need = F.col("_first") + later
    state = F.when((F.col("_first") == 0) | (F.col("_must") < need), "MISSING").when((need > slots) | (need > budget), "UNSATISFIABLE").otherwise("COMPLETE")
    own = budget - F.least(F.lit(later * most), budget - F.col("_first"))

    def step(acc: Column, x: Column) -> Column:
        done = F.size(acc["cuts"])
        first = F.floor(acc["own"] / (F.col("_first") - done))
        share = F.when(x["phase"] == 0, first).when(x["phase"] == 1, F.floor(acc["left"] / (F.col("_must") - done))).otherwise(acc["left"])
        cut = F.least(x["n"], F.lit(most), share.cast("int"))
        over = (x["phase"] == 2) & ((done >= slots) | (acc["left"] <= 0))
        used = F.when(over, 0).otherwise(cut)
        return F.struct((acc["own"] - used).alias("own"), (acc["left"] - used).alias("left"), F.concat(acc["cuts"], F.array(F.when(over, -1).otherwise(cut))).alias("cuts"))

    start = F.struct(own.cast("int").alias("own"), F.lit(budget).alias("left"), F.array().cast("array<int>").alias("cuts"))
    g = g.withColumn("state", state).withColumn("_cuts", F.aggregate("x", start, step)["cuts"])
    chosen = F.filter(F.arrays_zip("x", F.col("_cuts").alias("cut")), lambda z: z["cut"] >= 0)
    each = g.select(group, "state", F.posexplode_outer(F.when(F.col("state") == "COMPLETE", chosen)).alias("order", "z"))
    excerpt = F.left("z.x.text", F.col("z.cut"))
    return each.select(group, "state", F.col("order").cast("long").alias("order"), "z.x.kind", "z.x.index", excerpt.alias("excerpt"), (F.col("z.x.n") > F.col("z.cut")).alias("truncated"))


def memory_counts(records: DataFrame, group: str, status: str = "status") -> DataFrame:
    """(group, record_count, canonical_count, staged_count): how many of a group's records are canonical, how many still on their way."""
    c = F.col(status)
    return records.groupBy(group).agg(F.count(F.lit(1)).alias("record_count"), F.count_if(c == "CANONICAL").alias("canonical_count"), F.count_if(c.isin(*STAGED)).alias("staged_count"))


def newest(records: DataFrame, at: str, key: str, n: int = 100, status: str | None = None) -> DataFrame:
    """The newest records, of a status if one is given; ties end in the key."""
    return (records.where(F.col("status") == status) if status else records).orderBy(F.desc(at), key).limit(n)


def client_buffer(events: DataFrame, n: int = 200, key: str = "event_id", order: str = "ordering_id") -> DataFrame:
    """The newest n events in their order, each once: what a client that keeps n shows after all of these."""
    once = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("_e")).select(key, "_e.*")
    return once.orderBy(F.desc(order)).limit(n).orderBy(order)


def client_drops(events: DataFrame, n: int = 200, key: str = "event_id") -> DataFrame:
    """One row: how many different events came, and how many a client that keeps n let go."""
    return events.agg(F.count_distinct(key).alias("received")).withColumn("dropped", F.greatest(F.col("received") - n, F.lit(0)))


def capabilities(observed: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, id, status, provenance): the ten capabilities of projects.

    observed, a row a project: governance_ok, decisions_ok, memory_ok, index_status, retrieval_status, dependency_status, and the counts commits, runs, modules,
    quality_points. What is counted is available once there is any; decisions and memory together are degraded if one of them is missing.
    """
    any_of = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    told = lambda fine: (F.when(fine, "AVAILABLE").otherwise("UNAVAILABLE"), F.when(fine, "EXACT").otherwise("UNAVAILABLE"))
    given = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    both, one = F.col("decisions_ok") & F.col("memory_ok"), F.col("decisions_ok") | F.col("memory_ok")
    dependency = given("dependency_status")
    rows = {
        "project-intelligence": (F.lit("AVAILABLE"), F.lit("EXACT")),
        "checkpoint-scope-dod": told(F.coalesce("governance_ok", F.lit(False))),
        "index-health": (given("index_status"), F.lit("EXACT")),
        "latest-commits": told(any_of("commits")),
        "run-history": told(any_of("runs")),
        "decisions-memory": (F.when(both, "AVAILABLE").when(one, "DEGRADED").otherwise("UNAVAILABLE"), F.when(both, "EXACT").when(one, "UNKNOWN").otherwise("UNAVAILABLE")),
        "modules-symbols": told(any_of("modules")),
        "dependency-graph": (dependency, F.when(dependency == "AVAILABLE", "EXACT").when(dependency == "UNKNOWN", "UNKNOWN").otherwise("UNAVAILABLE")),
        "quality-history": told(any_of("quality_points")),
        "retrieval-quality": (given("retrieval_status"), F.lit("EXACT")),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("id"), s.alias("status"), p.alias("provenance")) for k, (s, p) in rows.items()])
    return observed.select(project, F.explode(listed).alias("c")).select(project, "c.*")


def snapshot(sections: dict[str, DataFrame], project: str = "project_id") -> DataFrame:
    """(project, section, id, status, provenance): sections such as capabilities, charts, alerts and health as one long table, without a shuffle."""
    parts = [df.select(project, F.lit(name).alias("section"), "id", "status", "provenance") for name, df in sections.items()]
    return reduce(DataFrame.unionByName, parts)
