"""Queries over the shared tables for the reference's kind of operators, each beside the same question in DuckDB SQL.

The tables stand for a project's knowledge and telemetry: events for telemetry (a run is a user), documents for sources, embeddings for vectors,
conversations for memory and context items, orders, lineitem and part for tasks, their files and the files' contents, customer for projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import corpus, events, memory, patches, postings, retrieval
from ..streaming import events as stream
from .registry import covers_sql, lexemes_sql, query, table

#: What the test table's event types stand for.
EVENT_TYPES = {"purchase": "run.completed", "error": "run.failed", "signup": "executor.started", "click": "cache.hit", "view": "cache.miss"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items()) + " END"
_T = f"""t AS (SELECT event_id AS ordering_id, user_id AS run_id, user_id % 10 AS project_id, {_CASE} AS event_type, ts AS occurred_at, value, props,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
_M = f"""{_T}, m AS (SELECT run_id, project_id, ordering_id, occurred_at, value, CASE k % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'cached' ELSE 'output' END AS key,
    CASE event_type WHEN 'run.completed' THEN 'EXACT' WHEN 'cache.hit' THEN 'ESTIMATED' WHEN 'cache.miss' THEN 'UNKNOWN' END AS provenance FROM t),
    r AS (SELECT *, CASE provenance WHEN 'EXACT' THEN 3 WHEN 'ESTIMATED' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END AS rank FROM m),
    s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY rank DESC, occurred_at DESC, ordering_id DESC) = 1)"""
_NAME = "CASE coalesce({}, 0) WHEN 3 THEN 'EXACT' WHEN 2 THEN 'ESTIMATED' WHEN 1 THEN 'UNKNOWN' ELSE 'UNAVAILABLE' END"
_W = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


def as_telemetry(df: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])[F.col("event_type")]
    return df.select(
        F.col("event_id").alias("ordering_id"), F.col("user_id").alias("run_id"), (F.col("user_id") % 10).alias("project_id"), kind.alias("event_type"),
        F.col("ts").alias("occurred_at"), "value", "props", F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_telemetry(table(spark, sf_dir, "events"))


def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(F.lit("input"), F.lit("cached"), F.lit("output")), (F.col("k") % 3 + 1).cast("int"))
    provenance = F.when(F.col("event_type") == "run.completed", "EXACT").when(F.col("event_type") == "cache.hit", "ESTIMATED").when(F.col("event_type") == "cache.miss", "UNKNOWN")
    return telemetry(spark, sf_dir).select("run_id", "project_id", "ordering_id", "occurred_at", "value", key.alias("key"), provenance.alias("provenance"))


# Telemetry


@query(f"WITH {_T} SELECT ordering_id, run_id, event_type, (SELECT count(*) > 100 FROM t) AS has_more FROM t ORDER BY ordering_id LIMIT 100")
def event_page_first(spark, sf_dir):
    return events.page(telemetry(spark, sf_dir)).select("ordering_id", "run_id", "event_type", "has_more")


@query(f"WITH {_T} SELECT ordering_id, run_id, event_type, (SELECT count(*) > 100 FROM t WHERE ordering_id > 500) AS has_more FROM t WHERE ordering_id > 500 ORDER BY ordering_id LIMIT 100")
def event_page_after_cursor(spark, sf_dir):
    return events.page(telemetry(spark, sf_dir), cursor=500).select("ordering_id", "run_id", "event_type", "has_more")


@query(f"WITH {_T}, u AS (SELECT * FROM t WHERE run_id = 8) SELECT ordering_id, run_id, event_type, (SELECT count(*) > 50 FROM u) AS has_more FROM u ORDER BY ordering_id LIMIT 50")
def run_event_page(spark, sf_dir):
    return events.page(telemetry(spark, sf_dir).where("run_id = 8"), limit=50).select("ordering_id", "run_id", "event_type", "has_more")


@query(f"WITH {_T} SELECT ordering_id, run_id, event_type, value FROM t ORDER BY ordering_id DESC LIMIT 100")
def recent_events_window(spark, sf_dir):
    return events.newest(telemetry(spark, sf_dir)).select("ordering_id", "run_id", "event_type", "value")


_RUNS = f"""WITH {_T}, g AS (SELECT run_id, count(*) AS n_events, arg_min(occurred_at, ordering_id) AS first_at, arg_max(occurred_at, ordering_id) AS last_at,
    arg_max(event_type, ordering_id) AS last_type, bool_or(event_type = 'executor.started') AS started,
    arg_max(event_type, ordering_id) FILTER (WHERE event_type IN ('run.completed', 'run.failed')) AS terminal, max(ordering_id) AS last_ordering FROM t GROUP BY run_id)
    SELECT *, CASE WHEN terminal = 'run.completed' THEN 'COMPLETED' WHEN terminal = 'run.failed' THEN 'FAILED' WHEN started THEN 'ACTIVE' ELSE 'OBSERVED' END AS status FROM g"""


@query(_RUNS)
def run_aggregates(spark, sf_dir):
    return events.runs(telemetry(spark, sf_dir))


@query(f"SELECT status, count(*) AS n, CAST(sum(n_events) AS BIGINT) AS n_events FROM ({_RUNS}) GROUP BY status")
def run_status_counts(spark, sf_dir):
    return events.runs(telemetry(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_events").alias("n_events"))


_TESTS = f"""WITH {_T}, g AS (SELECT run_id, count(*) FILTER (WHERE event_type = 'executor.started') AS started, count(*) FILTER (WHERE event_type = 'run.completed') AS passed,
    count(*) FILTER (WHERE event_type = 'run.failed') AS failed FROM t GROUP BY run_id)
    SELECT *, CASE WHEN failed > 0 THEN 'FAILED' WHEN passed > 0 THEN 'PASSED' WHEN started > passed + failed THEN 'RUNNING' ELSE 'UNRECORDED' END AS status FROM g"""


@query(_TESTS)
def test_status(spark, sf_dir):
    return events.test_status(telemetry(spark, sf_dir))


@query(f"WITH {_T} SELECT count(DISTINCT run_id) AS n FROM t WHERE run_id NOT IN (SELECT run_id FROM t WHERE event_type IN ('run.completed', 'run.failed'))")
def runs_without_tests(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return t.select("run_id").distinct().join(t.where(F.col("event_type").isin(*events.TERMINAL)).select("run_id"), "run_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_T} SELECT ordering_id, run_id, left(props, 200) AS summary FROM t WHERE event_type = 'run.failed' ORDER BY ordering_id DESC LIMIT 50")
def error_list(spark, sf_dir):
    failed = telemetry(spark, sf_dir).where("event_type = 'run.failed'")
    return failed.orderBy(F.desc("ordering_id")).limit(50).select("ordering_id", "run_id", F.left("props", F.lit(200)).alias("summary"))


@query(f"WITH {_T} SELECT project_id, event_type, count(*) AS n FROM t GROUP BY project_id, event_type")
def activity_histogram(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("project_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_T} SELECT project_id, run_id || '-' || k AS emission_key, min(ordering_id) AS ordering_id, count(*) AS copies FROM t GROUP BY ALL")
def idempotent_append(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("emission_key", F.concat_ws("-", "run_id", "k")).withColumn("content", F.col("props"))
    return events.deduplicated(t)


@query(f"WITH {_M} SELECT run_id, key, value, provenance, ordering_id FROM s")
def token_metric_select(spark, sf_dir):
    return events.selected(token_metrics(spark, sf_dir)).select("run_id", "key", "value", "provenance", "ordering_id")


@query(f"WITH {_M} SELECT project_id, key, round(sum(value), 4) AS total, {_NAME.format('min(rank) FILTER (WHERE value IS NOT NULL)')} AS provenance FROM s GROUP BY project_id, key")
def token_metrics_total(spark, sf_dir):
    return events.summed(events.selected(token_metrics(spark, sf_dir)), "project_id", "key").withColumn("total", F.round("total", 4))


@query(f"""WITH {_M}, p AS (SELECT project_id, key, sum(value) AS total, min(rank) AS rank FROM s WHERE value IS NOT NULL GROUP BY project_id, key)
    SELECT key, round(sum(total), 4) AS total, {_NAME.format('min(rank)')} AS provenance FROM p GROUP BY key""")  # fmt: skip
def metrics_global_rollup(spark, sf_dir):
    per = events.summed(events.selected(token_metrics(spark, sf_dir)), "project_id", "key")
    return events.summed(per.withColumnRenamed("total", "value"), "key").withColumn("total", F.round("total", 4))


@query(f"""WITH {_M}, p AS (SELECT run_id, max(value) FILTER (WHERE key = 'input') AS input, max(value) FILTER (WHERE key = 'cached') AS cached,
    max(rank) FILTER (WHERE key = 'input') AS ri, max(rank) FILTER (WHERE key = 'cached') AS rc FROM s GROUP BY run_id)
    SELECT run_id, CASE WHEN ri > 1 AND rc > 1 THEN round(greatest(input - cached, 0), 6) END AS fresh, {_NAME.format('CASE WHEN ri > 1 AND rc > 1 THEN least(ri, rc) END')} AS provenance FROM p""")  # fmt: skip
def fresh_tokens(spark, sf_dir):
    return events.fresh_tokens(token_metrics(spark, sf_dir)).withColumn("fresh", F.round("fresh", 6))


@query(f"""WITH {_T}, g AS (SELECT project_id, sum(value) FILTER (WHERE event_type = 'cache.miss') AS b, sum(value) FILTER (WHERE event_type = 'cache.hit') AS a FROM t GROUP BY project_id)
    SELECT project_id, round(b, 4) AS before, round(a, 4) AS after, round(b - a, 4) AS reduction, round(least(1, greatest(0, (b - a) / nullif(b, 0))), 4) AS ratio FROM g""")  # fmt: skip
def context_reduction(spark, sf_dir):
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")))
    g = telemetry(spark, sf_dir).groupBy("project_id").agg(of("cache.miss").alias("b"), of("cache.hit").alias("a"))
    return g.select("project_id", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"), F.round(F.col("b") - F.col("a"), 4).alias("reduction"), C.ratio(F.col("b") - F.col("a"), F.col("b")).alias("ratio"))


@query(f"WITH {_T}, g AS (SELECT project_id, count(*) FILTER (WHERE event_type = 'cache.hit') AS hits, count(*) FILTER (WHERE event_type = 'cache.miss') AS misses FROM t GROUP BY project_id) SELECT *, round(hits / nullif(hits + misses, 0), 6) AS rate FROM g")
def cache_metrics(spark, sf_dir):
    return events.cache_rates(telemetry(spark, sf_dir), "project_id")


def _running_sql(good: str, bad: str) -> str:
    w = "OVER (PARTITION BY run_id ORDER BY ordering_id)"
    return f"WITH {_T}, g AS (SELECT run_id, ordering_id, CAST(sum((event_type = '{good}')::INT) {w} AS BIGINT) AS good, CAST(sum((event_type = '{bad}')::INT) {w} AS BIGINT) AS bad FROM t) SELECT *, round(good / (good + bad), 6) AS rate FROM g WHERE good + bad > 0"


@query(_running_sql("cache.hit", "cache.miss"))
def running_hit_rate(spark, sf_dir):
    return events.running(telemetry(spark, sf_dir), F.col("event_type") == "cache.hit", F.col("event_type") == "cache.miss")


@query(_running_sql("run.completed", "run.failed"))
def running_pass_rate(spark, sf_dir):
    return events.running(telemetry(spark, sf_dir), F.col("event_type") == "run.completed", F.col("event_type") == "run.failed")


@query(f"""WITH {_T}, g AS (SELECT run_id, count(*) AS n, sum(value) AS s, arg_max(value, ordering_id) AS latest FROM t WHERE value IS NOT NULL GROUP BY run_id)
    SELECT run_id, n, latest, round((s - latest) / nullif(n - 1, 0), 6) AS before, coalesce(n >= 3 AND latest > 2 * ((s - latest) / nullif(n - 1, 0)), false) AS spike FROM g""")  # fmt: skip
def token_spike(spark, sf_dir):
    return events.spikes(telemetry(spark, sf_dir))


@query(f"WITH {_T} SELECT run_id, arg_max(event_type, ordering_id) AS state, max(ordering_id) AS as_of FROM t WHERE event_type IN ('executor.started', 'run.completed', 'run.failed') GROUP BY run_id")
def executor_connection(spark, sf_dir):
    return events.last_state(telemetry(spark, sf_dir), ["executor.started", *events.TERMINAL])


@query(f"WITH {_T} SELECT run_id, event_type, ordering_id, value, row_number() OVER (PARTITION BY run_id, event_type ORDER BY ordering_id DESC) AS back FROM t QUALIFY back <= 20")
def metric_history(spark, sf_dir):
    return events.history(telemetry(spark, sf_dir))


@query(f"SELECT run_id, n_events, last_type, status FROM ({_RUNS})")
def stream_run_fold(spark, sf_dir):
    path = f"{sf_dir}/events.parque[t]"  # a pattern: a stream reads single files by pattern only
    return stream.fold(spark, path, lambda df: df, lambda df: events.runs(as_telemetry(df)), "event_id").select("run_id", "n_events", "last_type", "status")


# Storage, tasks, fleet

_SIZES = "round(sum(n * size), 2) AS logical, round(sum(size), 2) AS physical, round(least(1, greatest(0, (round(sum(n * size), 2) - round(sum(size), 2)) / nullif(round(sum(n * size), 2), 0))), 4) AS saved"


def files_and_blobs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("blob"))
    return lines, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob"), F.col("p_retailprice").alias("size"))


@query(f"WITH g AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS files, count(*) AS blobs, {_SIZES.replace('size', 'p_retailprice')} FROM g JOIN part ON l_partkey = p_partkey")
def storage_stats(spark, sf_dir):
    return corpus.stored_sizes(*files_and_blobs(spark, sf_dir))


@query(f"WITH g AS (SELECT o_custkey, l_partkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT o_custkey, CAST(sum(n) AS BIGINT) AS files, count(*) AS blobs, {_SIZES.replace('size', 'p_retailprice')} FROM g JOIN part ON l_partkey = p_partkey GROUP BY o_custkey")
def project_storage_observation(spark, sf_dir):
    lines, blobs = files_and_blobs(spark, sf_dir)
    owned = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "blob")
    return corpus.stored_sizes(owned, blobs, "o_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def orphan_blobs(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey")
    return table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def referenced_blobs(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey")
    return table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("SELECT o_orderkey, c_name, n_name, o_totalprice, o_orderstatus = 'F' AND o_totalprice IS NOT NULL AS ready FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def tasks_star(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", "c_name", "n_name", "o_totalprice", ((F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNotNull()).alias("ready"))


@query("SELECT o_orderstatus, l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL")
def parts_of_current_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang NULLS LAST LIMIT 32")
def language_counts(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), F.asc_nulls_last("lang")).limit(32)


@query("WITH s(state) AS (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('RETIRED')) SELECT state, count(c_custkey) AS n FROM s LEFT JOIN customer ON c_mktsegment = state GROUP BY state")
def fleet_state_counts(spark, sf_dir):
    states = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "RETIRED"]
    n = table(spark, sf_dir, "customer").agg(*[F.count_if(F.col("c_mktsegment") == s).alias(s) for s in states])
    return n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in states])).alias("r")).select("r.*")


@query("SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def fleet_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    page = c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(100).limit(50).select("c_custkey", "c_acctbal")
    return page.crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("""WITH r AS (SELECT c_nationkey, md5(c_name || '|' || c_mktsegment) AS h FROM customer)
    SELECT c_nationkey, count(*) AS n_rows, md5(CAST(sum(('0x' || left(h, 15))::BIGINT::HUGEINT) AS VARCHAR) || '|' || CAST(sum(('0x' || substring(h, 17, 15))::BIGINT::HUGEINT) AS VARCHAR)) AS digest FROM r GROUP BY c_nationkey""")  # fmt: skip
def table_digests(spark, sf_dir):
    return corpus.group_digests(table(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws("|", "c_name", "c_mktsegment").alias("row")), "c_nationkey", "row")


@query("""WITH m AS (SELECT p_brand, p_partkey, p_retailprice AS speed, CAST(p_size AS DOUBLE) AS size FROM part), x AS (SELECT *,
    row_number() OVER (PARTITION BY p_brand ORDER BY speed DESC, size, p_partkey) AS h, row_number() OVER (PARTITION BY p_brand ORDER BY speed / nullif(size, 0) DESC NULLS LAST, p_partkey) AS w,
    row_number() OVER (PARTITION BY p_brand ORDER BY size, speed DESC, p_partkey) AS c FROM m)
    SELECT p_brand, p_partkey, 'HOT' AS tier FROM x WHERE h = 1 UNION ALL SELECT p_brand, p_partkey, 'WARM' FROM x WHERE w = 1 UNION ALL SELECT p_brand, p_partkey, 'COLD' FROM x WHERE c = 1""")  # fmt: skip
def storage_tier_winner(spark, sf_dir):
    m = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("speed"), F.col("p_size").cast("double").alias("size"))
    return corpus.tier_winners(m, "p_brand", "p_partkey")


@query("""SELECT coalesce(c_custkey, o_custkey) AS custkey, CASE WHEN c_custkey IS NULL THEN 'added' WHEN o_custkey IS NULL THEN 'removed' WHEN total IS NOT DISTINCT FROM c_acctbal THEN 'unchanged' ELSE 'changed' END AS change
    FROM customer FULL JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")  # fmt: skip
def discovery_refresh(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("content"))
    return corpus.changes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("content")), found, "custkey", "content")


# Columns


@query("SELECT doc_id, sha256(text) AS sha256, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, left(sha256(text), 8) AS short_id FROM documents")
def sha256_text(spark, sf_dir):
    h = C.sha256_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("sha256"), C.token_estimate(F.col("text")).alias("tokens"), F.left(h, F.lit(8)).alias("short_id"))


@query("SELECT doc_id, sha256(unhex(lpad(to_hex(strlen(lang)), 16, '0')) || encode(lang) || unhex(lpad(to_hex(strlen(text)), 16, '0')) || encode(text)) AS fingerprint FROM documents")
def list_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.list_fingerprint(F.col("lang"), F.col("text")).alias("fingerprint"))


@query("""WITH b AS (SELECT page_id, regexp_replace(url, '^.*/', '') AS base FROM pages), s AS (SELECT *, lower(regexp_extract(base, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM b)
    SELECT page_id, base, CASE x WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json'
    WHEN 'sql' THEN 'sql' WHEN 'html' THEN 'html' WHEN 'css' THEN 'css' END AS language FROM s""")  # fmt: skip
def path_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", C.basename(url).alias("base"), C.file_language(url).alias("language"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '(?i)(password|passwd|secret|token|api_?key)[\"'']?\\s*[:=]|akia[0-9a-z]{12,}'), false) AS secret, length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS length FROM documents")
def secret_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.has_secret(F.col("text")).alias("secret"), F.length(C.newline_normalise(F.col("text"))).cast("long").alias("length"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k FROM events")
def json_number_guard(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.json_number(F.col("props"), "k").alias("k"))


# Corpus


@query()
def chunk_windows(spark, sf_dir):
    return corpus.chunks(table(spark, sf_dir, "documents"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
    SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, length(x) AS n_chars FROM l""")  # fmt: skip
def text_lines(spark, sf_dir):
    return corpus.text_lines(table(spark, sf_dir, "documents"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) - 1 AS reused FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return corpus.distinct_contents(table(spark, sf_dir, "documents"))


@query("""WITH s AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents), w AS (SELECT source || '/' || (doc_id + 10) AS path, sha256(upper(text)) AS h FROM documents)
    SELECT coalesce(s.path, w.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed' WHEN s.h IS NOT DISTINCT FROM w.h THEN 'unchanged' ELSE 'changed' END AS change FROM s FULL JOIN w ON s.path = w.path""")  # fmt: skip
def file_change_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = lambda i: F.concat("source", F.lit("/"), i.cast("string")).alias("path")
    stored = d.select(path(F.col("doc_id")), C.sha256_text(F.col("text")).alias("sha256"))
    return corpus.changes(stored, d.select(path(F.col("doc_id") + 10), C.sha256_text(F.upper("text")).alias("sha256")))


@query("SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS contents, count(*) FILTER (WHERE lang IS NULL) AS unknown, count(DISTINCT lang) AS languages FROM documents GROUP BY source")
def corpus_status_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", C.sha256_text(F.col("text")).alias("h"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("contents"), F.count_if(F.col("lang").isNull()).alias("unknown"), F.count_distinct("lang").alias("languages"))


@query("SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT CASE WHEN vec_id IS NOT NULL THEN doc_id END) AS covered FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_coverage(spark, sf_dir):
    return corpus.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def embeddings_missing(spark, sf_dir):
    return corpus.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


# Retrieval

_LEX = f"SELECT doc_id, lang, round(CAST(0.1 * n AS DOUBLE), 6) AS score FROM (SELECT *, len([x for x in {lexemes_sql('text')} if x = 'the']) AS n FROM documents) WHERE n > 0"
_SEM = "SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS distance FROM embeddings"


def first_vector(spark, sf_dir) -> list[float]:
    """The query vector of the examples: that of the smallest id, one row."""
    found = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).collect()
    return found[0]["embedding"] if found else [0.0]


@query(f"{_LEX} ORDER BY score DESC, lang NULLS LAST, doc_id LIMIT 20")
def lexical_term_topk(spark, sf_dir):
    return retrieval.lexical(table(spark, sf_dir, "documents"), "the")


@query(_LEX.replace("0.1 *", "CASE WHEN lower(lang) = 'the' THEN 1.5 ELSE 0 END + CASE WHEN lower(source) = 'the' THEN 4 ELSE 0 END + 0.1 *"))
def lexical_boosts(spark, sf_dir):
    return retrieval.lexical(table(spark, sf_dir, "documents"), "The", top_k=None)


@query(f"WITH n AS MATERIALIZED (SELECT doc_id, {lexemes_sql('text')} AS w FROM documents), c AS ({covers_sql('n', 'doc_id', 'w', ['the', 'and', 'of'])}) SELECT doc_id, lang, round(score, 6) AS score FROM c JOIN documents USING (doc_id)")
def lexical_multi_term(spark, sf_dir):
    return retrieval.lexical(table(spark, sf_dir, "documents"), "the and of", top_k=None)


@query("""WITH p AS (SELECT doc_id, text, list_min([x for x in [instr(lower(text), 'und'), instr(lower(text), 'the')] if x > 0]) AS p FROM documents),
    c AS (SELECT *, greatest(0, coalesce(p, 1) - 1 - 213) AS a FROM p), s AS (SELECT *, CASE WHEN a + 640 > length(text) THEN greatest(0, length(text) - 640) ELSE a END AS start FROM c)
    SELECT doc_id, p AS at, CASE WHEN length(text) <= 640 THEN text ELSE CASE WHEN start > 0 THEN '...' ELSE '' END || substring(text, start + 1, 640) || CASE WHEN start + 640 < length(text) THEN '...' ELSE '' END END AS snippet FROM s""")  # fmt: skip
def snippet_window(spark, sf_dir):
    tokens = F.array(F.lit("und"), F.lit("the"))
    at = F.array_min(F.filter(F.transform(tokens, lambda t: F.instr(F.lower("text"), t)), lambda p: p > 0))
    return table(spark, sf_dir, "documents").select("doc_id", at.cast("long").alias("at"), C.snippet(F.col("text"), tokens).alias("snippet"))


@query(f"{_SEM} ORDER BY distance, vec_id LIMIT 20")
def semantic_topk(spark, sf_dir):
    return retrieval.semantic(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir))


@query(f"SELECT * FROM ({_SEM}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) = 1")
def semantic_best_by_kind(spark, sf_dir):
    return retrieval.best_per(retrieval.semantic(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), None), "label", [F.asc("distance"), F.asc("vec_id")])


_HYB = f"""l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, lang NULLS LAST, doc_id) AS lexical_rank FROM ({_LEX}) QUALIFY lexical_rank <= 20),
    s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS semantic_rank FROM ({_SEM}) QUALIFY semantic_rank <= 20),
    h AS (SELECT id, lexical_rank, semantic_rank, round(coalesce(1 / (60 + lexical_rank), 0) + coalesce(1 / (60 + semantic_rank), 0), 9) AS score FROM l FULL JOIN s USING (id) ORDER BY score DESC, id LIMIT 20)"""


@query(f"WITH {_HYB} SELECT * FROM h")
def hybrid_rrf(spark, sf_dir):
    lex = retrieval.ranked(lexical_term_topk(spark, sf_dir), [F.desc("score"), F.asc_nulls_last("lang"), F.asc("doc_id")], "lexical_rank").select(F.col("doc_id").alias("id"), "lexical_rank")
    sem = retrieval.ranked(semantic_topk(spark, sf_dir), [F.asc("distance"), F.asc("vec_id")], "semantic_rank").select(F.col("vec_id").alias("id"), "semantic_rank")
    return retrieval.hybrid(lex, sem)


@query(f"""WITH {_HYB}, c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS hybrid_rank FROM h)
    SELECT id, hybrid_rank, round(len(list_intersect(list_distinct({_W}), ['the', 'and', 'of'])) / 3, 6) AS overlap FROM c JOIN documents ON id = doc_id ORDER BY overlap DESC, hybrid_rank LIMIT 5""")  # fmt: skip
def rerank_overlap(spark, sf_dir):
    candidates = retrieval.ranked(hybrid_rrf(spark, sf_dir), [F.desc("score"), F.asc("id")], "hybrid_rank").select("id", "hybrid_rank")
    return retrieval.reranked(candidates, table(spark, sf_dir, "documents"), "the and of")


_MANY = f"""a AS (SELECT DISTINCT item_id, unnest({_W}) AS word FROM benchmark), p AS (SELECT DISTINCT doc_id, unnest({_W}) AS word FROM documents),
    o AS (SELECT item_id, doc_id, count(*) AS overlap FROM p JOIN a USING (word) GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM o QUALIFY rank <= 5)"""


@query(f"WITH {_MANY} SELECT * FROM q")
def search_many(spark, sf_dir):
    terms = F.array_distinct(C.words(F.col("text")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), terms.alias("w"))
    return postings.search_overlap(spark, postings.unindexed(docs, F.col("w")), table(spark, sf_dir, "benchmark").select("item_id", terms.alias("terms")))


_EVAL = f"""{_MANY}, rel AS (SELECT DISTINCT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    f AS (SELECT b.item_id, min(rank) AS first, b.item_id % 2 = 0 AS critical FROM benchmark b LEFT JOIN (SELECT * FROM q JOIN rel USING (item_id, doc_id)) USING (item_id) GROUP BY b.item_id)"""


@query(f"""WITH {_EVAL} SELECT count(*) AS queries, round(count(first) / nullif(count(*), 0), 4) AS recall, round(count(*) FILTER (WHERE first = 1) / nullif(count(*), 0), 4) AS recall_at_1,
    round(coalesce(sum(1 / first), 0) / nullif(count(*), 0), 4) AS mrr, round(count(first) / nullif((SELECT count(*) FROM q), 0), 4) AS precision, count(*) FILTER (WHERE critical AND first IS NULL) AS critical_misses FROM f""")  # fmt: skip
def retrieval_eval(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    asked = items.select("item_id", (F.col("item_id") % 2 == 0).alias("critical"))
    return retrieval.evaluation(search_many(spark, sf_dir), retrieval.containing(docs, items), asked)


@query(f"WITH {_EVAL} SELECT item_id, doc_id FROM rel")
def passages_in_documents(spark, sf_dir):
    return retrieval.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Context and memory


@query("""WITH b AS (SELECT conv_id, turn, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, (CAST(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - 1 + 3) // 4 + 64 AS used FROM conversations)
    SELECT *, used <= 600 AS kept FROM b""")  # fmt: skip
def budget_trim(spark, sf_dir):
    return retrieval.within_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 600)


_BUDGET = """b AS (SELECT conv_id, turn, role = 'system' OR turn = 0 AS must, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, least(greatest(200 + 100 * (conv_id % 5), 300), 500) AS budget FROM conversations),
    t AS (SELECT *, sum(CASE WHEN must THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) + 64 AS base, sum(CASE WHEN must THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY must, turn ROWS UNBOUNDED PRECEDING) AS used FROM b)"""


@query(f"WITH {_BUDGET} SELECT conv_id, turn, tokens, budget, base <= budget AND (must OR base + used <= budget) AS kept, CASE WHEN base > budget THEN 'required_context_exceeds_token_budget' END AS error FROM t")
def adaptive_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("must", (F.col("role") == "system") | (F.col("turn") == 0))
    return retrieval.adaptive_budget(c, "conv_id", "turn", "text", "must", 200 + 100 * (F.col("conv_id") % 5), floor=300, ceiling=500)


@query("""WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM conversations)
    SELECT conv_id, turn, left(text, CAST(800 - x AS BIGINT)) AS excerpt FROM b WHERE x < 800""")  # fmt: skip
def result_char_cap(spark, sf_dir):
    return retrieval.cut_to_characters(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 800)


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) = 1")
def first_occurrence_dedup(spark, sf_dir):
    return memory.first_occurrences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), F.col("text"), ["conv_id", "turn"])


_STATE = "CASE role WHEN 'system' THEN 'OBSERVATION' WHEN 'user' THEN 'PROPOSED' ELSE 'CONFIRMED' END"


def memory_history(spark, sf_dir) -> DataFrame:
    state = F.when(F.col("role") == "system", "OBSERVATION").when(F.col("role") == "user", "PROPOSED").otherwise("CONFIRMED")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("state"), "text")


@query(f"""WITH h AS (SELECT conv_id, turn, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT *, before IS NULL OR before = state OR (before = 'OBSERVATION' AND state IN ('PROPOSED', 'CONFIRMED')) OR (before = 'PROPOSED' AND state = 'CONFIRMED') AS allowed FROM h""")  # fmt: skip
def memory_transitions(spark, sf_dir):
    return memory.transitions(memory_history(spark, sf_dir), "conv_id", "turn", "state")


@query(f"SELECT conv_id, max(turn) AS version, arg_max({_STATE}, turn) AS state, arg_max(text, turn) AS text, count(*) AS versions FROM conversations GROUP BY conv_id")
def memory_current(spark, sf_dir):
    return memory.current(memory_history(spark, sf_dir), "conv_id", "turn", "state", "text")


@query("""WITH x AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events), y AS (SELECT *, json_extract_string(props, '$.k') AS k, json_extract_string(old, '$.k') AS o FROM x)
    SELECT event_id, CASE WHEN old IS NULL THEN 'add' ELSE 'replace' END AS op, '/k' AS path, k AS value FROM y WHERE k IS DISTINCT FROM o""")  # fmt: skip
def json_diff_top_level(spark, sf_dir):
    from pyspark.sql import Window

    old = F.lag("props").over(Window.partitionBy("user_id").orderBy("event_id"))
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    e = table(spark, sf_dir, "events").withColumn("old", old)
    return e.select("event_id", F.explode(memory.map_diff(as_map(F.col("old")), as_map(F.col("props")))).alias("d")).select("event_id", "d.*")


_STATES = """x AS (SELECT event_id, '{"event":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"note":"a note that stays the same from one state to the next, so a patch is smaller"}' AS new,
    event_type, json_extract_string(props, '$.k') AS k, lag(event_type) OVER w AS e0, lag(json_extract_string(props, '$.k')) OVER w AS k0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def run_states(spark, sf_dir) -> DataFrame:
    """Each event's state of its run as JSON, and the state before."""
    from pyspark.sql import Window

    note = F.lit(',"note":"a note that stays the same from one state to the next, so a patch is smaller"}')
    e = table(spark, sf_dir, "events").withColumn("new", F.concat(F.lit('{"event":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), note))
    return e.select("event_id", "new", F.lag("new").over(Window.partitionBy("user_id").orderBy("event_id")).alias("old"))


@query(f"""WITH {_STATES}, p AS (SELECT *, '{{"operations":[' || array_to_string([o for o in [CASE WHEN event_type <> e0 THEN '{{"op":"replace","path":"/event","value":"' || event_type || '"}}' END,
    CASE WHEN k <> k0 THEN '{{"op":"replace","path":"/k","value":' || k || '}}' END] if o IS NOT NULL], ',') || '],"version":"v1"}}' AS patch FROM x)
    SELECT event_id, CASE WHEN e0 IS NULL THEN 'FULL_NO_BASE' WHEN strlen(patch) >= strlen(new) THEN 'FULL_NOT_SMALLER' ELSE 'DELTA' END AS delivery, CASE WHEN e0 IS NOT NULL THEN strlen(patch) END AS patch_bytes FROM p""")  # fmt: skip
def delta_or_full(spark, sf_dir):
    x = patches.with_delivery(run_states(spark, sf_dir), "old", "new")
    return x.select("event_id", "delivery", F.octet_length("patch").cast("long").alias("patch_bytes"))


@query("""WITH x AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system') AS p, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system') AS s FROM conversations GROUP BY 1)
    SELECT conv_id, sha256(coalesce(p, '')) AS prefix_sha256, CAST(strlen(coalesce(p, '')) AS BIGINT) AS prefix_bytes, CAST(strlen(coalesce(s, '')) AS BIGINT) AS suffix_bytes FROM x""")  # fmt: skip
def prompt_segments(spark, sf_dir):
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "text")))), lambda r: r["text"]), "\n")
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined(F.col("role") == "system").alias("p"), joined(F.col("role") != "system").alias("s"))
    return x.select("conv_id", C.sha256_text(F.col("p")).alias("prefix_sha256"), F.octet_length("p").cast("long").alias("prefix_bytes"), F.octet_length("s").cast("long").alias("suffix_bytes"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def acceptance_matrix(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
