"""Charts and alerts of projects, and provider usage, folded from event payloads.

Events have project_id, ordering_id, event_type, occurred_at and payload (a JSON object as text); a payload that is no JSON has no values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import named_provenance, payload_provenance, variant_flag, variant_integer, variant_number, variant_string

#: Charts, in the order in which they are shown.
CHARTS = (
    "tokens-over-time", "cached-vs-fresh-tokens", "token-savings", "cost-over-time", "cache-hit-rate", "context-reduction", "context-signal-ratio",
    "physical-vs-logical-storage", "compression-dedup-savings", "project-activity", "test-pass-failure-rate", "retrieval-latency", "service-latency-errors",
)
#: Payload keys that count tokens.
TOKEN_KEYS = ("input_tokens", "output_tokens", "token_count", "token_budget")
COLUMNS = ("project_id", "chart", "series", "ordering_id", "value", "provenance")


def parsed(events: DataFrame) -> DataFrame:
    return events.withColumn("_p", F.try_parse_json("payload"))


def passed(kind: Column) -> Column:
    """true for a test that passed, false for one that failed, null for what is no test."""
    flag = F.when(kind == "test.finished", variant_flag(F.col("_p"), "passed"))
    return F.when(kind == "validation.passed", True).when(kind.isin("validation.failed", "run.failed"), False).otherwise(flag)


def event_points(events: DataFrame, points: int) -> DataFrame:
    """The newest points of each chart whose points are values of single events; only as many rows per project and chart are shuffled by each task."""
    p = F.col("_p")
    n = {k: variant_number(p, k) for k in (*TOKEN_KEYS, "cached_tokens", "fresh_tokens", "token_savings", "estimated_tokens_before", "estimated_tokens_after", "useful_context_tokens", "total_context_tokens_sent", "latency_ms")}
    values = parsed(events).select("project_id", "ordering_id", "event_type", "_p", payload_provenance(p).alias("_sure"), *[v.alias(k) for k, v in n.items()])
    c = F.col
    sure = lambda key: F.coalesce(named_provenance(variant_string(p, f"{key}_provenance")), c("_sure"))

    def point(chart: Column | str, series: str, value: Column, provenance: Column) -> Column:
        return F.struct((F.lit(chart) if isinstance(chart, str) else chart).alias("chart"), F.lit(series).alias("series"), value.alias("value"), provenance.alias("provenance"))

    at_least_0 = lambda v: F.when(v >= 0, v)
    fresh = F.coalesce(c("fresh_tokens"), F.greatest(c("input_tokens") - c("cached_tokens"), F.when(c("input_tokens").isNotNull() & c("cached_tokens").isNotNull(), 0.0)))
    savings = F.coalesce(c("token_savings"), F.when(c("input_tokens").isNotNull(), c("cached_tokens")))
    reduction = F.when((c("estimated_tokens_before") >= 0) & (c("estimated_tokens_after") >= 0), c("estimated_tokens_before") - c("estimated_tokens_after"))
    used, sent = c("useful_context_tokens"), c("total_context_tokens_sent")
    made = [
        *[point("tokens-over-time", k, at_least_0(c(k)), sure(k)) for k in TOKEN_KEYS],
        point("cached-vs-fresh-tokens", "cached", at_least_0(c("cached_tokens")), sure("cached_tokens")),
        point("cached-vs-fresh-tokens", "fresh", at_least_0(fresh), sure("fresh_tokens")),
        point("token-savings", "token-savings", at_least_0(savings), sure("token_savings")),
        point("context-reduction", "reduction_tokens", reduction, F.lit("ESTIMATED")),
        point("context-signal-ratio", "useful_context_ratio", F.when((used >= 0) & (sent > 0) & (used <= sent), used / F.nullif(sent, F.lit(0.0))), sure("useful_context_tokens")),
        point(F.when(F.contains("event_type", F.lit("retriev")), "retrieval-latency").otherwise("service-latency-errors"), "latency_ms", at_least_0(c("latency_ms")), sure("latency_ms")),
    ]
    rows = values.select("project_id", "ordering_id", F.posexplode(F.array(*made)).alias("_at", "x")).select("project_id", "ordering_id", "_at", "x.*").where("value IS NOT NULL")
    newest = Window.partitionBy("project_id", "chart").orderBy(F.desc("ordering_id"), F.desc("_at"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= points).select(*COLUMNS)


def rate_points(events: DataFrame, chart: str, series: str, outcome: Column, points: int, every_event: bool) -> DataFrame:
    """The newest points of a running share of good outcomes (true, false or null per event).

    Only the newest `points` events of a project are sorted: what lies before them enters through the project's totals.
    """
    rows = parsed(events).select("project_id", "ordering_id", outcome.alias("ok"))
    rows = rows if every_event else rows.where("ok IS NOT NULL")
    good, bad = F.count_if(F.col("ok")), F.count_if(~F.col("ok"))
    totals = rows.groupBy("project_id").agg(good.alias("_good"), bad.alias("_bad"))
    order = Window.partitionBy("project_id").orderBy(F.desc("ordering_id"))
    after = order.rowsBetween(Window.unboundedPreceding, -1)
    last = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= points).join(totals, "project_id")
    left = lambda total, hit: F.col(total) - F.coalesce(F.sum(hit.cast("long")).over(after), F.lit(0))
    last = last.select("project_id", "ordering_id", left("_good", F.coalesce("ok", F.lit(False))).alias("g"), left("_bad", ~F.coalesce("ok", F.lit(True))).alias("b")).where("g + b > 0")
    return last.select("project_id", F.lit(chart).alias("chart"), F.lit(series).alias("series"), "ordering_id", (F.col("g") / (F.col("g") + F.col("b"))).alias("value"), F.lit("EXACT").alias("provenance"))


def chart_points(events: DataFrame, storage: DataFrame, points: int = 100) -> DataFrame:
    """(project_id, chart, series, ordering_id, value, provenance): the newest points of all charts. storage: project_id, logical, physical."""
    kind = F.col("event_type")
    cache = F.when(kind == "cache.hit", True).when(kind == "cache.miss", False)
    fixed = lambda df, chart, series, value: df.select("project_id", F.lit(chart).alias("chart"), series.alias("series"), F.lit(None).cast("long").alias("ordering_id"), value.cast("double").alias("value"), F.lit("EXACT").alias("provenance"))
    activity = events.groupBy("project_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        event_points(events, points),
        rate_points(events, "cache-hit-rate", "hit_rate", cache, points, False),
        rate_points(events, "test-pass-failure-rate", "pass_rate", passed(kind), points, True),
        fixed(activity, "project-activity", F.col("event_type"), F.col("n")),
        fixed(storage, "physical-vs-logical-storage", F.lit("logical"), F.col("logical")),
        fixed(storage, "physical-vs-logical-storage", F.lit("physical"), F.col("physical")),
        fixed(storage, "compression-dedup-savings", F.lit("storage-savings"), F.greatest(F.col("logical") - F.col("physical"), F.lit(0.0))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def chart_status(points: DataFrame, projects: DataFrame, most: int = 100) -> DataFrame:
    """(project_id, chart, status, points, scaled_last): every chart of every project; one without points is UNAVAILABLE. The last value is scaled to the chart's least and greatest."""
    n = points.groupBy("project_id", "chart").agg(F.count("value").alias("points"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max_by("value", F.struct("ordering_id", "series")).alias("last"))
    every = projects.select("project_id", F.explode(F.array(*map(F.lit, CHARTS))).alias("chart"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("last") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    found = every.join(n, ["project_id", "chart"], "left")
    return found.select("project_id", "chart", F.when(F.col("points") > 0, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"), F.coalesce("points", F.lit(0)).cast("long").alias("points"), scaled.alias("scaled_last"))


def alerts(events: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, alert, status, provenance): twelve alerts of each project, from one fold of its events.

    projects: project_id, state, index_status, retrieval_status, redis, postgres (names of checks' results, null: unknown), disk_free (0 to 1) and
    checkpoint_status. A project without events has UNKNOWN where events decide. What is unknown is never clear.
    """
    kind, p = F.col("event_type"), F.col("_p")
    tokens = [F.when(variant_number(p, k) >= 0, variant_number(p, k)) for k in ("input_tokens", "output_tokens", "token_count")]
    said = F.lower(variant_string(p, "connection_status"))
    flag = lambda k: F.coalesce(variant_flag(p, k), F.lit(False))
    off = flag("executor_disconnected") | flag("disconnected") | F.coalesce(said == "disconnected", F.lit(False))
    on = flag("executor_heartbeat") | flag("heartbeat") | F.coalesce(said.isin("connected", "heartbeat"), F.lit(False))
    test = F.when(kind != "run.failed", passed(kind))
    e = parsed(events).select(
        "project_id", "ordering_id", kind, F.filter(F.array(*tokens), lambda t: t.isNotNull()).alias("t"), F.when(off, "ACTIVE").when(on, "CLEAR").alias("link"), test.alias("ok")
    )
    order = F.col("ordering_id")
    f = e.groupBy("project_id").agg(
        F.count_if(kind.isin("cache.hit", "cache.miss")).alias("looked"), F.count_if(kind == "cache.hit").alias("hits"),
        F.sum(F.size("t")).alias("n"), F.sum(F.aggregate("t", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.max_by(F.try_element_at("t", F.lit(-1)), F.when(F.size("t") > 0, order)).alias("last"),
        F.max_by("link", F.when(F.col("link").isNotNull(), order)).alias("link"), F.bool_or(~F.col("ok")).alias("failed"), F.bool_or("ok").alias("passed"),
    )
    c = F.col
    yes_no = lambda known, bad, other="UNKNOWN": F.when(known & bad, "ACTIVE").when(known, "CLEAR").otherwise(other)
    before = (c("total") - c("last")) / F.nullif(c("n") - 1, F.lit(0))
    found = {
        "disk-low": yes_no(c("disk_free").isNotNull(), c("disk_free") < 0.10, "UNAVAILABLE"),
        "redis-unavailable": yes_no(c("redis").isNotNull(), c("redis") != "ok"),
        "postgres-unavailable": yes_no(c("postgres").isNotNull(), c("postgres") != "ok"),
        "project-stale": F.when(c("state") == "STALE", "ACTIVE").otherwise("CLEAR"),
        "index-inconsistent": F.when(c("index_status") == "DEGRADED", "ACTIVE").when(c("index_status") == "AVAILABLE", "CLEAR").otherwise("UNKNOWN"),
        "retrieval-degradation": F.when(c("retrieval_status") == "DEGRADED", "ACTIVE").when(c("retrieval_status") == "AVAILABLE", "CLEAR").otherwise("UNKNOWN"),
        "cache-hit-collapse": yes_no(c("looked") >= 5, c("hits") / F.nullif(c("looked"), F.lit(0)) < 0.20),
        "token-spike": yes_no(c("n") >= 3, c("last") > before * 2),
        "unexpected-cost-spike": F.lit("UNAVAILABLE"),
        "failed-test-build": F.when(c("failed"), "ACTIVE").when(c("passed"), "CLEAR").otherwise("UNKNOWN"),
        "executor-disconnected": F.coalesce("link", F.lit("UNKNOWN")),
        "checkpoint-mismatch": F.coalesce("checkpoint_status", F.lit("UNAVAILABLE")),
    }
    rows = projects.join(f, "project_id", "left").select("project_id", F.explode(F.array(*[F.struct(F.lit(k).alias("alert"), v.alias("status")) for k, v in found.items()])).alias("a")).select("project_id", "a.*")
    always = c("alert").isin("index-inconsistent", "retrieval-degradation")
    return rows.withColumn("provenance", F.when(always | ~c("status").isin("UNKNOWN", "UNAVAILABLE"), "EXACT").otherwise("UNAVAILABLE"))


def usage_receipts(df: DataFrame, usage: str) -> DataFrame:
    """`df` with what a provider's usage report (JSON text) is worth: total, cached, fresh, output, observed_hit, reconciliation, warning.

    Takes the strict fields (total_input_tokens, cached_input_tokens, output_tokens) or the common ones (prompt_tokens and its details,
    completion_tokens, total_tokens). No report is UNKNOWN, a malformed or inconsistent one INVALID; neither gives a number or a hit.
    """
    c, p = F.col, F.col("_p")
    only = lambda *names: F.size(F.array_except("_keys", F.array(*map(F.lit, names)))) == 0
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(p, f"$.{k}", "variant")), F.lit("VOID"))
    fields = {"total": ("total_input_tokens", "prompt_tokens"), "cached": ("cached_input_tokens", "prompt_tokens_details.cached_tokens"), "output": ("output_tokens", "completion_tokens")}
    u = df.withColumns({"_p": F.try_parse_json(usage), "_keys": F.coalesce(F.json_object_keys(usage), F.array(F.lit("no object")))})
    u = u.withColumns({"_own": only(*(x for x, _ in fields.values())), "_common": only("prompt_tokens", "prompt_tokens_details", "completion_tokens", "total_tokens")})
    u = u.withColumns({f"_{k}": F.when(c("_own"), variant_integer(p, a)).otherwise(variant_integer(p, b)) for k, (a, b) in fields.items()})
    u = u.withColumns({f"_{k}_kind": F.when(c("_own"), kind(a)).otherwise(kind(b)) for k, (a, b) in fields.items()} | {"_details": kind("prompt_tokens_details")})
    odd = [~c(f"_{k}_kind").isin("VOID", "BIGINT") for k in fields] + [~c("_own") & (c("_details") != "VOID") & ~F.startswith("_details", F.lit("OBJECT"))]
    negative = F.least("_total", "_cached", "_output") < 0
    warning = (
        F.when(c(usage).isNull(), "provider_usage_not_reported").when(~c("_own") & ~c("_common"), "provider_usage_unknown_fields").when(odd[0] | odd[1] | odd[2] | odd[3], "provider_usage_integer_required")
        .when(negative, "provider_usage_negative").when(c("_total").isNull() | c("_cached").isNull(), "provider_usage_reconciliation_incomplete").when(c("_cached") > c("_total"), "provider_usage_cached_exceeds_total")
    )
    u = u.withColumn("warning", warning)
    good = {"total": c("_total"), "cached": c("_cached"), "fresh": c("_total") - c("_cached"), "output": c("_output"), "observed_hit": c("_cached") > 0}
    state = F.when(c(usage).isNull(), "UNKNOWN").when(c("warning").isNull(), "EXACT").otherwise("INVALID")
    return u.select(*df.columns, *[F.when(c("warning").isNull(), v).alias(k) for k, v in good.items()], state.alias("reconciliation"), "warning")
