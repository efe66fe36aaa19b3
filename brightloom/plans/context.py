"""Queries of payload checks, diffs, governing sections, memory lists, client buffers and the snapshot of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import payloads as P
from . import charts
from .queries import memory_history
from .registry import ORACLE_SQL, query, table

#: Payloads by event_id % 9, and why each is refused.
_PAYLOADS = {
    0: ('{"k": %d}', None), 1: ('{"input_tokens": %d, "note": "fine"}', None), 2: ('{"client_api_key": "x%d"}', "secret_key"), 3: ('{"note": "password=hunter%d"}', "secret_value"),
    4: ('{"a":{"b":{"c":{"d":{"e":{"f":{"g":%d}}}}}}}', "depth"), 5: ("[%d]", "not_object"), 6: ('{"n": 9007199254740993, "i": %d}', "integer"), 7: ('{"note": "see %%2Fetc%%2Fpasswd", "i": %d}', "path"),
    8: ("{%d", "not_json"),
}


def _cases(cases: dict, i) -> F.Column:
    made = F.lit(None).cast("string")
    for k, (form, _) in cases.items():
        made = F.when(i % len(cases) == k, F.format_string(form, i)).otherwise(made)
    return made


def _told(cases: dict) -> str:
    return f"CASE event_id % {len(cases)} " + " ".join(f"WHEN {k} THEN '{why}'" for k, (_, why) in cases.items() if why) + " END"


@query(f"SELECT event_id, {_told(_PAYLOADS)} AS fault FROM events")
def payload_validation(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", _cases(_PAYLOADS, i).alias("payload"))
    return e.select("event_id", P.payload_fault(spark, F.col("payload")).alias("fault"))


#: Arguments by event_id % 7, and why each is refused.
_ARGUMENTS = {
    0: ('{"query": "q%d", "limit": 5}', None), 1: ('{"query": "q%d"}', None), 2: ('{"limit": 5, "i": %d}', "unknown_key"), 3: ('{"limit": 5}', "missing_key"),
    4: ('{"query": "q%d", "limit": true}', "not_integer"), 5: ('{"query": "q%d", "limit": 101}', "bound"), 6: ('["q%d"]', "not_object"),
}


@query(f"SELECT event_id, {_told(_ARGUMENTS)} AS fault FROM events")
def tool_arguments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", _cases(_ARGUMENTS, F.col("event_id")).alias("a"))
    return e.select("event_id", P.argument_fault(F.col("a"), ("query",), {"limit": (1, 100)}, ("limit",)).alias("fault"))


@query("""WITH x AS (SELECT event_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events)
    SELECT event_id, CASE WHEN a = b THEN '' ELSE '--- a/state+++ b/state@@ ' || CASE WHEN a IS NULL THEN '-0,0 +1 @@' ELSE '-1 +1 @@-' || a END || '+' || b END AS diff FROM x""")  # fmt: skip
def state_diffs(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("event_id", before.alias("a"), F.col("event_type").alias("b"))
    return e.select("event_id", P.unified_diff(spark, F.lit("state"), F.col("a"), F.col("b"))["text"].alias("diff"))


#: Endings that the example files have, by doc_id % 5.
_ENDINGS = (".py", ".tsx", "/Dockerfile", ".rs", ".txt")


@query("""WITH s AS (SELECT source, list_distinct(list(doc_id % 5)) AS x FROM documents GROUP BY source)
    SELECT source, array_to_string([l[2] FOR l IN [[0, 1], [1, 2], [3, 3], [2, 4]] IF list_contains(x, l[1])], ',') AS n, len(list_filter(x, lambda y: y <> 4)) AS languages FROM s""")  # fmt: skip
def language_stacks(spark, sf_dir):
    endings = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("source", F.regexp_replace(F.concat(F.lit("src/f"), "doc_id", endings), "^.*/", "").alias("name"))
    numbers = F.create_map(*[x for k, v in (("python", "1"), ("typescript", "2"), ("rust", "3"), ("docker", "4")) for x in (F.lit(k), F.lit(v))])
    s = P.language_stacks(files, "source")
    return s.select("source", F.array_join(F.transform("languages", lambda x: numbers[x]), ",").alias("n"), F.size("languages").cast("long").alias("languages"))


@query("""SELECT doc_id, left(array_to_string([p FOR p IN [trim(left(coalesce(source, ''), 128)), regexp_replace(left(coalesce(text, ''), 192), '^\\s+|\\s+$', '', 'g'), trim(left('use ' || coalesce(lang, ''), 96)), 'pass'] IF p <> ''], ' '), 512) AS query FROM documents""")
def derived_queries(spark, sf_dir):
    constraints = F.array(F.concat(F.lit("use "), F.coalesce("lang", F.lit(""))))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", G.derived_query(F.col("source"), F.col("text"), constraints, F.array(F.lit("pass"))).alias("query"))


@query("""SELECT event_id, (event_id % 5 NOT IN (1, 2, 3)) AND event_id % 7 <> 0 AND user_id % 3 > 0 AS eligible FROM events""")
def cache_eligibility(spark, sf_dir):
    i = F.col("event_id")
    rerank = F.element_at(F.array(*map(F.lit, ("RERANKED", *G.NOT_CACHED, "RERANK_FALLBACK_DISABLED"))), (i % 5 + 1).cast("int"))
    hybrid = F.when(i % 7 == 0, G.PROVIDER_ERROR).otherwise("HYBRID")
    return table(spark, sf_dir, "events").select("event_id", G.cache_eligible(rerank, hybrid, F.lit(None).cast("string"), F.col("user_id") % 3).alias("eligible"))


def governing_sections(spark, sf_dir) -> DataFrame:
    """Tasks are hundreds of documents: of kinds by doc_id % 4, scored by what their texts say."""
    kind = F.element_at(F.array(*map(F.lit, ("CHECKPOINT", "SCOPE", "DECISIONS", "STANDARDS"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").where((F.col("doc_id") % 4 > 0) | (F.col("doc_id") % 100 < 16))
    score = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b(the|and)\b"), F.lit(0)))
    return d.select(F.floor(F.col("doc_id") / 100).alias("task_id"), kind.alias("kind"), F.col("doc_id").alias("index"), "text", score.alias("score"))


@query()
def governance_selection(spark, sf_dir):
    return G.governance(governing_sections(spark, sf_dir), ("CHECKPOINT", "SCOPE", "DECISIONS", "STANDARDS"))


_MEMORY = "CASE role WHEN 'system' THEN 'OBSERVATION' WHEN 'user' THEN 'PROPOSED' ELSE 'CONFIRMED' END"


@query(f"""WITH r AS (SELECT conv_id, arg_max(CASE WHEN turn > 2 THEN 'CANONICAL' ELSE {_MEMORY} END, turn) AS status FROM conversations GROUP BY conv_id)
    SELECT conv_id % 10 AS project_id, count(*) AS record_count, count(*) FILTER (WHERE status = 'CANONICAL') AS canonical_count, count(*) FILTER (WHERE status <> 'CANONICAL') AS staged_count FROM r GROUP BY 1""")  # fmt: skip
def memory_status_counts(spark, sf_dir):
    h = memory_history(spark, sf_dir).groupBy("conv_id").agg(F.max_by(F.when(F.col("turn") > 2, "CANONICAL").otherwise(F.col("state")), "turn").alias("status"))
    return G.memory_counts(h.withColumn("project_id", F.col("conv_id") % 10), "project_id")


@query(f"""WITH r AS (SELECT conv_id, max(turn) AS updated, arg_max({_MEMORY}, turn) AS status FROM conversations GROUP BY conv_id)
    SELECT conv_id, updated, status FROM r WHERE status = 'CONFIRMED' ORDER BY updated DESC, conv_id LIMIT 50""")  # fmt: skip
def memory_list(spark, sf_dir):
    h = memory_history(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("updated"), F.max_by("state", "turn").alias("status"))
    return G.newest(h, "updated", "conv_id", 50, "CONFIRMED")


@query("SELECT event_id, event_id AS ordering_id, event_type FROM events ORDER BY ordering_id DESC LIMIT 200")
def client_buffer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("ordering_id"), "event_type")
    return G.client_buffer(e.unionByName(e.where("event_id % 3 = 0")))


@query("SELECT count(DISTINCT event_id) AS received, greatest(count(DISTINCT event_id) - 200, 0) AS dropped FROM events")
def client_drops(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return G.client_drops(e.unionByName(e.where("event_id % 3 = 0")))


_OBSERVED = """o AS (SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_regionkey AS r, coalesce(n, 0) AS n, coalesce(q, 0) AS q FROM nation LEFT JOIN (
    SELECT user_id % 10 AS p, count(DISTINCT user_id) AS n, count(*) FILTER (WHERE event_type IN ('purchase', 'error', 'signup')) AS q FROM events GROUP BY 1) ON p = n_nationkey)"""
_YES = "('{0}', CASE WHEN {1} THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END, CASE WHEN {1} THEN 'EXACT' ELSE 'UNAVAILABLE' END)"
_STATE = "CASE r WHEN 3 THEN 'DEGRADED' WHEN 4 THEN 'AVAILABLE' ELSE 'UNKNOWN' END"
_CAPABILITIES = ", ".join(
    [
        "('project-intelligence', 'AVAILABLE', 'EXACT')", _YES.format("checkpoint-scope-dod", "r = 2"), f"('index-health', {_STATE}, 'EXACT')", _YES.format("latest-commits", "r > 0"), _YES.format("run-history", "n > 0"),
        "('decisions-memory', CASE r WHEN 2 THEN 'AVAILABLE' WHEN 3 THEN 'DEGRADED' ELSE 'UNAVAILABLE' END, CASE r WHEN 2 THEN 'EXACT' WHEN 3 THEN 'UNKNOWN' ELSE 'UNAVAILABLE' END)", _YES.format("modules-symbols", "r > 1"),
        f"('dependency-graph', {_STATE}, CASE r WHEN 3 THEN 'UNAVAILABLE' WHEN 4 THEN 'EXACT' ELSE 'UNKNOWN' END)", _YES.format("quality-history", "q > 0"), f"('retrieval-quality', {_STATE}, 'EXACT')",
    ]
)


def capabilities(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("project_id"))
    e = e.agg(F.count_distinct("user_id").alias("runs"), F.count_if(F.col("event_type").isin("purchase", "error", "signup")).alias("quality_points"))
    r = F.col("n_regionkey")
    state = F.when(r == 3, "DEGRADED").when(r == 4, "AVAILABLE")
    p = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("project_id"), (r == 2).alias("governance_ok"), r.isin(2, 3).alias("decisions_ok"), (r == 2).alias("memory_ok"), r.alias("commits"), (r - 1).alias("modules"),
        *[state.alias(f"{k}_status") for k in ("index", "retrieval", "dependency")],
    )
    return G.capabilities(p.join(e, "project_id", "left"))


@query(f"""WITH {_OBSERVED}, c AS (SELECT project_id, unnest([{_CAPABILITIES}]) AS x FROM o)
    SELECT project_id, 'capability' AS section, x[1] AS id, x[2] AS status, x[3] AS provenance FROM c
    UNION ALL SELECT project_id, 'chart', chart, status, CASE status WHEN 'AVAILABLE' THEN 'EXACT' ELSE 'UNAVAILABLE' END FROM ({ORACLE_SQL["chart_status"]})
    UNION ALL SELECT project_id, 'alert', alert, status, provenance FROM ({ORACLE_SQL["alert_status"]})
    UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'health', h, 'UNAVAILABLE', 'UNAVAILABLE' FROM nation, (SELECT unnest(['container-status', 'platform-resource-health', 'local-model-health-conditional']) AS h)""")  # fmt: skip
def full_snapshot(spark, sf_dir):
    """38 rows a project; probes of hosts need services, so health is unavailable here."""
    told = F.when(F.col("status") == "AVAILABLE", "EXACT").otherwise("UNAVAILABLE")
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"))
    ids = F.array(*map(F.lit, ("container-status", "platform-resource-health", "local-model-health-conditional")))
    off = F.lit("UNAVAILABLE")
    return G.snapshot({
        "capability": capabilities(spark, sf_dir),
        "chart": charts.chart_status(spark, sf_dir).select("project_id", F.col("chart").alias("id"), "status", told.alias("provenance")),
        "alert": charts.alert_status(spark, sf_dir).withColumnRenamed("alert", "id"),
        "health": projects.select("project_id", F.explode(ids).alias("id"), off.alias("status"), off.alias("provenance")),
    })
