"""Queries of charts, alerts and provider usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts
from .registry import query, table

#: What the test table's event types stand for here.
KINDS = {"purchase": "test.finished", "error": "validation.failed", "signup": "validation.passed", "click": "cache.hit", "view": "cache.miss"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
_E = f"""e AS (SELECT event_id AS ordering_id, user_id % 10 AS project_id, {_KIND} AS event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
    v AS (SELECT *, CAST(k AS DOUBLE) AS input, CASE WHEN k % 3 = 0 THEN CAST(k // 2 AS DOUBLE) END AS cached, CASE WHEN k % 5 = 0 THEN CAST(k + 1 AS DOUBLE) END AS output,
    CASE WHEN k % 4 = 0 THEN 'ESTIMATED' ELSE 'UNKNOWN' END AS prov, CASE WHEN k % 11 = 0 THEN 'ACTIVE' WHEN k % 7 = 0 THEN 'CLEAR' END AS link,
    CASE event_type WHEN 'test.finished' THEN k % 2 = 0 WHEN 'validation.passed' THEN true WHEN 'validation.failed' THEN false END AS ok,
    CASE event_type WHEN 'cache.hit' THEN true WHEN 'cache.miss' THEN false END AS hit FROM e)"""
_RATE = """SELECT project_id, '{chart}' AS chart, '{series}' AS series, ordering_id, g / (g + b) AS value, 'EXACT' AS provenance FROM (SELECT *, sum(({c} IS TRUE)::INT) OVER w AS g, sum(({c} IS FALSE)::INT) OVER w AS b,
    row_number() OVER (PARTITION BY project_id ORDER BY ordering_id DESC) AS back FROM v {where} WINDOW w AS (PARTITION BY project_id ORDER BY ordering_id)) WHERE back <= 50 AND g + b > 0"""
_STORE = "SELECT c_nationkey AS project_id, round(sum(greatest(c_acctbal, 0)), 2) AS logical, round(sum(greatest(c_acctbal, 0)) / 2, 4) AS physical FROM customer GROUP BY 1"
_POINTS = f"""{_E}, s AS ({_STORE}), x AS (
    SELECT project_id, ordering_id, 1 AS pos, 'tokens-over-time' AS chart, 'input_tokens' AS series, input AS value, prov AS provenance FROM v
    UNION ALL SELECT project_id, ordering_id, 2, 'tokens-over-time', 'output_tokens', output, prov FROM v
    UNION ALL SELECT project_id, ordering_id, 3, 'cached-vs-fresh-tokens', 'cached', cached, prov FROM v
    UNION ALL SELECT project_id, ordering_id, 4, 'cached-vs-fresh-tokens', 'fresh', CASE WHEN cached IS NOT NULL THEN greatest(input - cached, 0) END, prov FROM v
    UNION ALL SELECT project_id, ordering_id, 5, 'token-savings', 'token-savings', cached, prov FROM v
    UNION ALL SELECT project_id, ordering_id, 6, 'context-reduction', 'reduction_tokens', CASE WHEN k % 6 = 0 THEN value - k END, 'ESTIMATED' FROM v WHERE value >= 0
    UNION ALL SELECT project_id, ordering_id, 7, 'context-signal-ratio', 'useful_context_ratio', CASE WHEN k % 9 = 0 AND k > 0 THEN (k // 3) / k END, prov FROM v
    UNION ALL SELECT project_id, ordering_id, 8, 'service-latency-errors', 'latency_ms', CASE WHEN value >= 0 THEN value END, prov FROM v),
    n AS (SELECT * FROM x WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, chart ORDER BY ordering_id DESC, pos DESC) <= 50),
    points AS (SELECT project_id, chart, series, ordering_id, round(value, 6) AS value, provenance FROM (SELECT project_id, chart, series, ordering_id, value, provenance FROM n
    UNION ALL {_RATE.format(chart="cache-hit-rate", series="hit_rate", c="hit", where="WHERE hit IS NOT NULL")} UNION ALL {_RATE.format(chart="test-pass-failure-rate", series="pass_rate", c="ok", where="")}
    UNION ALL SELECT project_id, 'project-activity', event_type, NULL, count(*), 'EXACT' FROM v GROUP BY 1, 3
    UNION ALL SELECT project_id, 'physical-vs-logical-storage', 'logical', NULL, logical, 'EXACT' FROM s UNION ALL SELECT project_id, 'physical-vs-logical-storage', 'physical', NULL, physical, 'EXACT' FROM s
    UNION ALL SELECT project_id, 'compression-dedup-savings', 'storage-savings', NULL, greatest(logical - physical, 0), 'EXACT' FROM s))"""


def payload_events(spark, sf_dir) -> DataFrame:
    """The events with a payload of the kinds of values that projects report."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordering_id"), (F.col("user_id") % 10).alias("project_id"), kind.alias("event_type"), F.col("ts").alias("occurred_at"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    k = F.col("k")
    of = lambda n, v: F.when(k % n == 0, v)
    payload = F.struct(
        k.alias("input_tokens"), of(3, F.expr("k DIV 2")).alias("cached_tokens"), of(5, k + 1).alias("output_tokens"), of(6, F.col("value")).alias("estimated_tokens_before"), of(6, k).alias("estimated_tokens_after"),
        F.when(k > 0, of(9, F.expr("k DIV 3"))).alias("useful_context_tokens"), of(9, k).alias("total_context_tokens_sent"), F.col("value").alias("latency_ms"), of(4, F.lit(True)).alias("estimated"),
        of(7, F.lit(True)).alias("heartbeat"), of(11, F.lit("disconnected")).alias("connection_status"), F.when(F.col("event_type") == "test.finished", k % 2 == 0).alias("passed"),
    )
    return e.select("project_id", "ordering_id", "event_type", "occurred_at", F.to_json(payload).alias("payload"))


def project_storage(spark, sf_dir) -> DataFrame:
    total = F.sum(F.greatest(F.col("c_acctbal"), F.lit(0.0)))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("project_id")).agg(F.round(total, 2).alias("logical"), F.round(total / 2, 4).alias("physical"))


@query(f"WITH {_POINTS} SELECT * FROM points")
def chart_points(spark, sf_dir):
    return charts.chart_points(payload_events(spark, sf_dir), project_storage(spark, sf_dir), 50).withColumn("value", F.round("value", 6))


_ALL = ", ".join(f"('{c}')" for c in charts.CHARTS)


@query(f"""WITH {_POINTS}, c(chart) AS (VALUES {_ALL}), g AS (SELECT project_id, chart, count(*) AS points, min(value) AS lo, max(value) AS hi, last(value ORDER BY ordering_id NULLS FIRST, series) AS last_value FROM points GROUP BY 1, 2)
    SELECT CAST(n_nationkey AS BIGINT) AS project_id, c.chart, CASE WHEN points > 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status, coalesce(points, 0) AS points, round(CASE WHEN hi > lo THEN (last_value - lo) / (hi - lo) END, 4) AS scaled_last
    FROM nation CROSS JOIN c LEFT JOIN g ON g.project_id = n_nationkey AND g.chart = c.chart""")  # fmt: skip
def chart_status(spark, sf_dir):
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"))
    return charts.chart_status(chart_points(spark, sf_dir), projects).withColumn("scaled_last", F.round("scaled_last", 4))


@query(f"""WITH {_E}, t AS (SELECT project_id, ordering_id, 1 AS pos, input AS x FROM v UNION ALL SELECT project_id, ordering_id, 2, output FROM v WHERE output IS NOT NULL),
    u AS (SELECT project_id, count(*) AS n, sum(x) AS total, last(x ORDER BY ordering_id, pos) AS latest FROM t GROUP BY 1),
    f AS (SELECT project_id, count(hit) AS looked, count(*) FILTER (WHERE hit) AS hits, bool_or(NOT ok) AS failed, bool_or(ok) AS passed, arg_max(link, ordering_id) FILTER (WHERE link IS NOT NULL) AS link FROM v GROUP BY 1),
    p AS (SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_regionkey AS r, n_nationkey / 40 AS disk FROM nation), j AS (SELECT * FROM p LEFT JOIN f USING (project_id) LEFT JOIN u USING (project_id)),
    a AS (SELECT project_id, unnest([{{'alert': 'disk-low', 'status': CASE WHEN disk < 0.1 THEN 'ACTIVE' ELSE 'CLEAR' END}}, {{'alert': 'redis-unavailable', 'status': CASE r WHEN 1 THEN 'CLEAR' WHEN 2 THEN 'ACTIVE' ELSE 'UNKNOWN' END}},
    {{'alert': 'postgres-unavailable', 'status': 'CLEAR'}}, {{'alert': 'project-stale', 'status': CASE WHEN r = 0 THEN 'ACTIVE' ELSE 'CLEAR' END}},
    {{'alert': 'index-inconsistent', 'status': CASE r WHEN 3 THEN 'ACTIVE' WHEN 4 THEN 'CLEAR' ELSE 'UNKNOWN' END}}, {{'alert': 'retrieval-degradation', 'status': CASE r WHEN 3 THEN 'ACTIVE' WHEN 4 THEN 'CLEAR' ELSE 'UNKNOWN' END}},
    {{'alert': 'cache-hit-collapse', 'status': CASE WHEN looked >= 5 AND hits / looked < 0.2 THEN 'ACTIVE' WHEN looked >= 5 THEN 'CLEAR' ELSE 'UNKNOWN' END}},
    {{'alert': 'token-spike', 'status': CASE WHEN n >= 3 AND latest > 2 * (total - latest) / (n - 1) THEN 'ACTIVE' WHEN n >= 3 THEN 'CLEAR' ELSE 'UNKNOWN' END}}, {{'alert': 'unexpected-cost-spike', 'status': 'UNAVAILABLE'}},
    {{'alert': 'failed-test-build', 'status': CASE WHEN failed THEN 'ACTIVE' WHEN passed THEN 'CLEAR' ELSE 'UNKNOWN' END}}, {{'alert': 'executor-disconnected', 'status': coalesce(link, 'UNKNOWN')}},
    {{'alert': 'checkpoint-mismatch', 'status': 'UNAVAILABLE'}}], recursive := true) FROM j)
    SELECT *, CASE WHEN alert IN ('index-inconsistent', 'retrieval-degradation') OR status NOT IN ('UNKNOWN', 'UNAVAILABLE') THEN 'EXACT' ELSE 'UNAVAILABLE' END AS provenance FROM a""")  # fmt: skip
def alert_status(spark, sf_dir):
    r = F.col("n_regionkey")
    index = F.when(r == 3, "DEGRADED").when(r == 4, "AVAILABLE")
    projects = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("project_id"), F.when(r == 0, "STALE").otherwise("READY").alias("state"), index.alias("index_status"), index.alias("retrieval_status"),
        F.when(r == 1, "ok").when(r == 2, "down").alias("redis"), F.lit("ok").alias("postgres"), (F.col("n_nationkey") / 40).alias("disk_free"), F.lit(None).cast("string").alias("checkpoint_status"),
    )
    return charts.alerts(payload_events(spark, sf_dir), projects)


#: Reports by event_id % 8, and what they are worth.
_USAGE = {
    0: ('{"total_input_tokens": %d, "cached_input_tokens": 0}', "EXACT", None), 1: ('{"prompt_tokens": %d, "prompt_tokens_details": {"cached_tokens": 1}, "completion_tokens": 2}', "EXACT", None),
    2: ('{"total_input_tokens": %d, "cached_input_tokens": -1}', "INVALID", "provider_usage_negative"), 3: ('{"total_input_tokens": %d, "cached_input_tokens": true}', "INVALID", "provider_usage_integer_required"),
    4: ('{"total_input_tokens": %d, "cached_input_tokens": 999999999}', "INVALID", "provider_usage_cached_exceeds_total"), 5: ('{"prompt_tokens": %d}', "INVALID", "provider_usage_reconciliation_incomplete"),
    6: ('{"tokens": %d}', "INVALID", "provider_usage_unknown_fields"), 7: (None, "UNKNOWN", "provider_usage_not_reported"),
}


@query(f"""SELECT event_id, CASE WHEN event_id % 8 < 2 THEN event_id END AS total, CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 END::BIGINT AS cached, CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN event_id - 1 END AS fresh,
    CASE WHEN event_id % 8 = 1 THEN 2::BIGINT END AS output, CASE event_id % 8 WHEN 0 THEN false WHEN 1 THEN true END AS observed_hit, CASE event_id % 8 {" ".join(f"WHEN {i} THEN '{x[1]}'" for i, x in _USAGE.items())} END AS reconciliation,
    CASE event_id % 8 {" ".join(f"WHEN {i} THEN '{x[2]}'" for i, x in _USAGE.items() if x[2])} END AS warning FROM events""")  # fmt: skip
def usage_receipts(spark, sf_dir):
    i = F.col("event_id")
    usage = F.lit(None).cast("string")
    for k, (report, _, _) in _USAGE.items():
        usage = F.when(i % 8 == k, F.format_string(report, i) if report else F.lit(None)).otherwise(usage)
    reports = table(spark, sf_dir, "events").select("event_id", usage.alias("usage"))
    return charts.usage_receipts(reports, "usage").drop("usage")
