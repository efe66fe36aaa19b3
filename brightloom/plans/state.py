"""Queries of keyed state in streams: cached values that expire, delta baselines, the newest events of each client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import state
from .registry import query, table

_OPS = """o AS (SELECT event_id AS request_id, CASE WHEN event_type = 'view' THEN 'put' ELSE 'get' END AS op, 'u' || user_id AS key, CASE WHEN event_type = 'view' THEN props END AS value, ts AS t FROM events)"""


def operations(spark, sf_dir) -> str:
    """Views put what they say under their user's key, all other events ask for it; in four files, by time."""
    e = table(spark, sf_dir, "events")
    view = F.col("event_type") == "view"
    path = shared_folder(spark, "operations")
    rows = e.select(F.col("event_id").alias("request_id"), F.when(view, "put").otherwise("get").alias("op"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.when(view, F.col("props")).alias("value"), F.col("ts").alias("at"))
    rows.repartitionByRange(4, "at").write.parquet(path)
    return path


@query(f"""WITH {_OPS}, w AS (SELECT *, last_value(CASE WHEN op = 'put' THEN value END IGNORE NULLS) OVER k AS v, last_value(CASE WHEN op = 'put' THEN t END IGNORE NULLS) OVER k AS since FROM o
        WINDOW k AS (PARTITION BY key ORDER BY t, op = 'get', request_id ROWS UNBOUNDED PRECEDING))
    SELECT request_id, key, t AS at, CASE WHEN t < since + INTERVAL 20 MINUTE THEN v END AS value FROM w WHERE op = 'get'""")  # fmt: skip
def expiring_values(spark, sf_dir):
    return state.expiring(spark, operations(spark, sf_dir), life=1200, late="60 days")


def baselines(spark, sf_dir) -> tuple[str, DataFrame]:
    """Each order is a task's context, cached and pointed to at its time; some pointers are corrupt, foreign, or their context is gone. Each is asked for once."""
    o = table(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("p"), F.col("o_custkey").alias("t"))
    at = F.timestamp_seconds(86400 + F.col("k") % 1000 * 10)
    fp = lambda kind: F.sha2(F.concat(F.lit(kind), F.col("k").cast("string")), 256)
    said = state.pointer(F.when(F.col("k") % 5 == 1, F.col("p") + 1).otherwise(F.col("p")), F.col("t"), fp("in"), fp("out"), F.sha1(F.col("k").cast("string")))
    said = F.when(F.col("k") % 5 == 2, F.left(said, F.lit(60))).otherwise(said)
    puts = o.select(F.lit(None).cast("long").alias("request_id"), F.lit("put").alias("op"), state.pointer_key(F.col("p"), F.col("t"), fp("out")).alias("key"), said.alias("value"), at.alias("at"))
    held = F.to_json(F.struct(F.lit(state.CACHE_VERSION).alias("schema_version"), F.col("p").cast("string").alias("project_id"), F.col("t").cast("string").alias("task_id"), fp("in").alias("context_input_fingerprint"), fp("out").alias("context_output_fingerprint"), F.col("k").cast("string").alias("serialized_capsule")))
    cached = o.where("k % 5 <> 3").select(F.lit(None).cast("long").alias("request_id"), F.lit("put").alias("op"), state.cache_key(F.col("p"), fp("in")).alias("key"), held.alias("value"), at.alias("at"))
    path = shared_folder(spark, "baselines")
    puts.unionByName(cached).write.parquet(path)
    asked = o.select(F.col("k").alias("request_id"), F.col("p").alias("project_id"), F.col("t").alias("task_id"), fp("out").alias("output"), (at + F.make_dt_interval(secs=(F.col("k") % 7 * 100).cast("decimal(18,6)"))).alias("at"))
    return path, asked


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey IS NOT NULL), f AS (SELECT k, k % 7 * 100 < 300 AND k % 5 NOT IN (1, 2) AS pointed FROM o)
    SELECT k AS request_id, CASE WHEN pointed THEN sha256('in' || k) END AS input_fingerprint, CASE WHEN pointed AND k % 5 <> 3 THEN k::VARCHAR END AS capsule, CASE WHEN NOT pointed THEN 'NO_POINTER' WHEN k % 5 = 3 THEN 'NO_CONTEXT' ELSE 'RESOLVED' END AS state FROM f""")  # fmt: skip
def delta_baselines(spark, sf_dir):
    return state.resolved_baselines(spark, *baselines(spark, sf_dir), late="1 day")


@query("""WITH r AS (SELECT 'u' || user_id AS client, event_id::VARCHAR AS id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS received FROM events)
    SELECT client, any_value(received) AS received, greatest(any_value(received) - 20, 0) AS dropped, string_agg(id || ':' || event_type, ' ' ORDER BY event_id) FILTER (WHERE n <= 20) AS events FROM r GROUP BY client""")  # fmt: skip
def stream_client_buffers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("ordering_id"), F.col("event_type").alias("event"))
    path = shared_folder(spark, "client-events")
    e.repartition(5, F.col("ordering_id")).write.parquet(path)
    got = state.client_buffers(spark, path, n=20, files_per_batch=2)
    shown = F.transform(F.from_json("events", "array<array<string>>"), lambda x: F.concat(x[1], F.lit(":"), x[2]))
    return got.withColumn("events", F.array_join(shown, " "))
