"""Queries of durable records, offline scorers and event frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sha256_text
from ..operators import memory, retrieval
from ..streaming import events as stream
from ..session import shared_folder
from .registry import query, table


@query("""SELECT o.o_orderkey AS memory_id, s.successor FROM orders o LEFT JOIN (SELECT o_orderkey // 3 AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS successor FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1) s ON s.k = o.o_orderkey""")
def memory_successors(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("memory_id"), F.when(F.col("o_orderkey") % 4 != 0, F.expr("o_orderkey DIV 3")).alias("supersedes"), F.col("o_orderdate").alias("created_at"))
    return memory.successors(o)


@query("""SELECT coalesce(c_custkey, s_suppkey + 100) AS id, coalesce('live ' || s_suppkey, c_mktsegment) AS state, s_suppkey IS NOT NULL AS live FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 100""")
def live_overrides(spark, sf_dir):
    live = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100).alias("id"), F.concat(F.lit("live "), F.col("s_suppkey").cast("string")).alias("state"))
    return memory.with_overrides(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state")), live, "id", "state")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id + 5 AS doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents
    UNION ALL SELECT doc_id + 1000000000, sha256(text) FROM documents), c AS (SELECT doc_id + 1000000000 AS doc_id, h FROM a UNION ALL SELECT * FROM a)
    SELECT coalesce(c.doc_id, b.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'unexpected' WHEN b.doc_id IS NULL THEN 'missing' WHEN c.h IS NOT DISTINCT FROM b.h THEN 'ok' ELSE 'mismatch' END AS result FROM c FULL JOIN b ON c.doc_id = b.doc_id""")  # fmt: skip
def digest_check(spark, sf_dir):
    """All documents under two names each: under the one the texts agree, under the other they were moved by five ids and some edited."""
    d, i, far = table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("doc_id") + 1_000_000_000
    edited = F.when(i % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    as_is = lambda at: d.select(at.alias("doc_id"), sha256_text(F.col("text")).alias("h"))
    moved = d.select((i + 5).alias("doc_id"), sha256_text(edited).alias("h"))
    return memory.digest_check(as_is(i).unionByName(as_is(far)), moved.unionByName(as_is(far)), "doc_id", "h")


@query("""SELECT n_regionkey, '[' || string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}', ',' ORDER BY n_name) || ']' AS rows FROM nation GROUP BY 1""")
def registry_identity(spark, sf_dir):
    return memory.rows_as_json(table(spark, sf_dir, "nation"), "n_regionkey", "n_name", "n_nationkey")


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_brand || ',' || p_type END AS tags FROM part")
def clean_tags(spark, sf_dir):
    tags = F.array(F.concat(F.lit("  "), "p_brand"), F.when(F.col("p_size") % 4 > 0, F.concat("p_type", F.lit(" "))).otherwise(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(memory.clean_tags(tags), ",").alias("tags"))


@query("""SELECT p_partkey, CASE WHEN length(f) <= 100 THEN f ELSE b END AS document FROM (SELECT p_partkey, '{"source_kind":"PART","path":"' || p_brand || '","title":"","qualified_symbol":"' || p_type || '","snippet":"' || repeat(p_name, 1 + p_size % 2) || '"}' AS f,
    '{"source_kind":"PART","path":"' || p_brand || '","title":"","qualified_symbol":"' || p_type || '","snippet":""}' AS b FROM part)""")  # fmt: skip
def rerank_documents(spark, sf_dir):
    snippet = F.repeat(F.col("p_name"), (1 + F.col("p_size") % 2).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", retrieval.rerank_document(F.lit("PART"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type"), snippet, 100).alias("document"))


_W = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"
_CONCEPTS = [["the", "of", "and"], ["license", "licensed"], ["a", "in"]]
_N = "[" + ", ".join(f"CAST(len(list_intersect({_W.format('text')}, {c})) AS DOUBLE)" for c in _CONCEPTS) + "]"


@query(f"WITH n AS (SELECT doc_id, {_N} AS n FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, n, sqrt(n[1] * n[1] + n[2] * n[2] + n[3] * n[3]) AS l FROM n) SELECT doc_id, round(coalesce(n[1] / nullif(l, 0), 0), 6) AS x, round(coalesce(n[2] / nullif(l, 0), 0), 6) AS y, round(coalesce(n[3] / nullif(l, 0), 0), 6) AS z FROM v")
def concept_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", retrieval.concept_vector(F.col("text"), _CONCEPTS).alias("v"))
    return v.select("doc_id", *[F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate("xyz")])


@query(f"""SELECT doc_id, round(len(list_intersect({_W.format("'the license of'")}, {_W.format("text")})) + CAST(('0x' || left(sha256('the license of' || chr(0) || text), 8)) AS BIGINT) / 4294967296 / 1000, 6) AS score FROM documents WHERE text IS NOT NULL""")
def overlap_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.round(retrieval.overlap_score(F.lit("the license of"), F.col("text")), 6).alias("score"))


@query("""SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {"event_type":"' || event_type || '","user_id":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def event_frames(spark, sf_dir):
    return stream.frames(table(spark, sf_dir, "events"), "event_id", "event_type", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500")
def stream_replay(spark, sf_dir):
    into = shared_folder(spark, "replay")
    return stream.replay(spark, f"{sf_dir}/events.parque[t]", into, 500).select("event_id", "user_id", "event_type")
