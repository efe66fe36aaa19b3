"""Queries over references to corpus chunks, each beside the same question in DuckDB SQL.

A document stands for a reference: its source for title and path, its language for the kind (German ones are tasks), its text for the chunk.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import sha256_text
from ..operators import postings
from ..operators import references as R
from .queries import first_vector
from .registry import covers_sql, lexemes_sql, query, table

_REFS = """r AS (SELECT doc_id AS reference_id, sha256(text) AS chunk_id, CASE WHEN lang = 'de' THEN 'TASK' ELSE lang END AS source_kind, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END AS task_id,
    'docs/' || source || '/' || (doc_id % 9) || '.md' AS path, source AS title, source || '.read' || doc_id % 7 AS symbol, CAST(doc_id % 3 AS BIGINT) AS start_line, text AS content FROM documents)"""


def references(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("reference_id"), sha256_text(F.col("text")).alias("chunk_id"), F.when(F.col("lang") == "de", "TASK").otherwise(F.col("lang")).alias("source_kind"), F.when(i % 5 > 0, i % 5).alias("task_id"),
        F.concat(F.lit("docs/"), "source", F.lit("/"), (i % 9).cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("title"),
        F.concat("source", F.lit(".read"), (i % 7).cast("string")).alias("symbol"), (i % 3).alias("start_line"), F.col("text").alias("content"),
    )


def _search_sql(raw: str, tokens: list[str], kind: str = "", limit: str = "") -> str:
    raw = raw.lower()
    return f"""WITH {_REFS}, n AS MATERIALIZED (SELECT *, {lexemes_sql('content')} AS c, {lexemes_sql("path || ' ' || title || ' ' || symbol")} AS m FROM r {kind}),
    cd AS ({covers_sql('n', 'reference_id', 'c', tokens)}), md AS ({covers_sql('n', 'reference_id', 'm', tokens)}),
    s AS (SELECT n.*, round(CAST(coalesce(cd.score, 0) + 1.5 * coalesce(md.score, 0) + CASE WHEN lower(symbol) = '{raw}' THEN 4 ELSE 0 END + CASE WHEN lower(path) = '{raw}' THEN 3 ELSE 0 END
        + CASE WHEN lower(regexp_replace(path, '^.*/', '')) = '{raw}' THEN 2 ELSE 0 END + CASE WHEN lower(title) = '{raw}' THEN 1.5 ELSE 0 END + CASE WHEN starts_with(lower(symbol), '{raw}.') THEN 1 ELSE 0 END AS DOUBLE), 6) AS score
        FROM n LEFT JOIN cd USING (reference_id) LEFT JOIN md USING (reference_id)
        WHERE cd.score IS NOT NULL OR md.score IS NOT NULL OR lower(path) = '{raw}' OR lower(title) = '{raw}' OR lower(symbol) = '{raw}')
    SELECT reference_id, source_kind, path, symbol, start_line, score FROM s
    QUALIFY row_number() OVER (PARTITION BY source_kind, CASE WHEN source_kind = 'TASK' THEN chunk_id ELSE CAST(reference_id AS VARCHAR) END ORDER BY score DESC, task_id NULLS LAST, reference_id) = 1
    ORDER BY score DESC, source_kind, lower(path), lower(symbol), start_line, reference_id {limit}"""


@query(_search_sql("src3", ["src", "3"]))
def reference_search_boosts(spark, sf_dir):
    return R.search(references(spark, sf_dir), "SRC3", top_k=None)


@query(_search_sql("the", ["the"], limit="LIMIT 20"))
def reference_search_topk(spark, sf_dir):
    return R.search(references(spark, sf_dir), "the")


@query(_search_sql("der", ["der"], "WHERE source_kind = 'TASK'"))
def reference_search_dedup(spark, sf_dir):
    return R.search(references(spark, sf_dir), "der", kind="TASK", top_k=None)


@query(_search_sql("the and", ["the", "and"]))
def reference_search_multi_term(spark, sf_dir):
    return R.search(references(spark, sf_dir), "the and", top_k=None)


#: Queries and their tokens: common and rare words, names, a hump, a faulty one.
_QUERIES = {1: ("the", ["the"]), 2: ("the and", ["the", "and"]), 3: ("src3.read", ["src", "3", "read"]), 4: ("src 3 Read", ["src", "3", "read"]), 5: ("docs/src1/4.md", ["docs", "src", "1", "4", "md"]), 6: ("zzzz the", ["zzzz", "the"]), 7: ("srcRead", ["src", "read"]), 8: (" ", [])}
_COLS = "reference_id, source_kind, path, symbol, start_line, score"
_ORDER = "score DESC, source_kind, lower(path), lower(symbol), start_line, reference_id"


@query(" UNION ALL ".join(f"SELECT {i} AS query_id, row_number() OVER (ORDER BY {_ORDER}) AS rank, {_COLS} FROM ({_search_sql(q, t, limit='LIMIT 20')})".replace("lower(regexp_replace(path, '^.*/', '')) = 'docs/src1/4.md'", "lower(regexp_replace(path, '^.*/', '')) = '4.md'") for i, (q, t) in _QUERIES.items() if t))
def reference_search_index(spark, sf_dir):
    index = postings.build_references(references(spark, sf_dir))
    queries = spark.createDataFrame([(i, q) for i, (q, _) in _QUERIES.items()], "query_id int, query string")
    return postings.search_references(spark, index, queries)


@query(f"WITH q AS (SELECT item_id AS query_id, left(text, 40) AS q, {lexemes_sql('left(text, 40)')} AS l, len(regexp_extract_all(left(text, 40), '[\\p{{L}}\\p{{N}}]+')) AS n FROM benchmark) SELECT query_id, lower(trim(q)) AS raw, array_to_string(list_sort(list_distinct(list_slice(l, n + 1, len(l)))), ' ') AS tokens, CAST(NULL AS VARCHAR) AS fault FROM q")
def normalised_queries(spark, sf_dir):
    q = postings.normalised_queries(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.left("text", F.lit(40)).alias("query")))
    return q.select("query_id", "raw", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), "fault")


_ELIGIBLE = """c AS (SELECT doc_id AS reference_id, doc_id % 2 AS project_id, doc_id % 7 <> 0 AS is_current, doc_id AS chunk_id, sha256(text) AS h FROM documents),
    v AS (SELECT vec_id AS chunk_id, vec_id % 3 AS run_id, embedding, CASE WHEN vec_id % 4 = 0 THEN 'old' END AS stale FROM embeddings)"""


def eligible(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    refs = d.select(i.alias("reference_id"), (i % 2).alias("project_id"), (i % 7 != 0).alias("is_current"), i.alias("chunk_id"))
    chunks = d.select(i.alias("chunk_id"), sha256_text(F.col("text")).alias("content_sha256"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 3).alias("run_id"), "embedding")
    v = v.join(chunks, "chunk_id").withColumn("content_sha256", F.when(F.col("chunk_id") % 4 == 0, "old").otherwise(F.col("content_sha256")))
    runs = spark.createDataFrame([(0, "COMPLETED"), (1, "FAILED"), (2, "COMPLETED")], "run_id long, status string")
    return R.eligible_vectors(refs, chunks, v, runs, 1)


@query(f"WITH {_ELIGIBLE} SELECT reference_id, c.chunk_id, run_id FROM c JOIN v USING (chunk_id) WHERE project_id = 1 AND is_current AND stale IS NULL AND run_id <> 1")
def eligible_vectors(spark, sf_dir):
    return eligible(spark, sf_dir).select("reference_id", "chunk_id", "run_id")


@query(f"""WITH {_ELIGIBLE}, d AS (SELECT reference_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS distance
    FROM c JOIN v USING (chunk_id) WHERE project_id = 1 AND is_current AND stale IS NULL AND run_id <> 1) SELECT *, round(1 / (1 + distance), 6) AS similarity FROM d ORDER BY distance, reference_id LIMIT 20""")  # fmt: skip
def semantic_eligible_topk(spark, sf_dir):
    return R.nearest(eligible(spark, sf_dir), first_vector(spark, sf_dir))


_PER = "SELECT source, count(*) AS n, count(vec_id) AS covered FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source"


@query(f"""SELECT source, n, covered, CASE WHEN source = 'src1' THEN 'LEXICAL_FALLBACK_PROVIDER_ERROR' WHEN source = 'src2' THEN 'LEXICAL_FALLBACK_SEMANTIC_STALE' WHEN covered < n THEN 'LEXICAL_FALLBACK_SEMANTIC_UNAVAILABLE' ELSE 'HYBRID' END AS hybrid,
    CASE WHEN source = 'src4' THEN 'INDEXING' WHEN source = 'src2' THEN 'STALE' WHEN covered < n THEN 'PARTIAL' ELSE 'READY' END AS corpus FROM ({_PER})""")  # fmt: skip
def hybrid_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    n = d.join(v, F.col("doc_id") == F.col("vec_id"), "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("vec_id").alias("covered"))
    stale = F.col("source") == "src2"
    return n.select("source", "n", "covered", R.hybrid_state(F.col("covered"), F.col("n"), stale, F.col("source") == "src1").alias("hybrid"), R.corpus_status(F.col("n"), F.col("covered"), stale, F.col("source") == "src4").alias("corpus"))


@query("""WITH r AS (SELECT user_id AS project_id, event_id AS run_id, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'FAILED' ELSE 'COMPLETED' END AS status, ts FROM events WHERE user_id % 3 > 0)
    SELECT c_custkey AS project_id, CASE WHEN l = 'RUNNING' THEN 'SYNCING' WHEN l = 'COMPLETED' THEN 'CURRENT' WHEN done THEN 'STALE' ELSE 'BLOCKED' END AS state, last_sync, latest_run
    FROM customer LEFT JOIN (SELECT project_id, arg_max(status, (ts, run_id)) AS l, arg_max(run_id, (ts, run_id)) AS latest_run, bool_or(status = 'COMPLETED') AS done, max(ts) FILTER (WHERE status = 'COMPLETED') AS last_sync FROM r GROUP BY 1) x ON x.project_id = c_custkey""")  # fmt: skip
def corpus_states(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "click", "FAILED").otherwise("COMPLETED")
    e = table(spark, sf_dir, "events").where("user_id % 3 > 0")
    runs = e.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"))
    return R.corpus_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id")), runs)


_SIDES = """l AS (SELECT conv_id AS query_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS l FROM conversations WHERE turn % 3 < 2),
    s AS (SELECT conv_id AS query_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS s FROM conversations WHERE turn % 3 > 0),
    st AS (SELECT DISTINCT conv_id AS query_id, CASE conv_id % 5 WHEN 0 THEN 'LEXICAL_FALLBACK_SEMANTIC_STALE' WHEN 1 THEN 'LEXICAL_FALLBACK_PROVIDER_ERROR' ELSE 'HYBRID' END AS state FROM conversations WHERE conv_id % 5 < 4)"""


@query(f"""WITH {_SIDES}, b AS (SELECT *, coalesce(state, 'LEXICAL_FALLBACK_SEMANTIC_UNAVAILABLE') AS st FROM (SELECT * FROM l FULL JOIN s USING (query_id, id)) LEFT JOIN st USING (query_id)),
    f AS (SELECT query_id, id, st AS state, CAST(round(coalesce(1.0::DOUBLE / (60 + l), 0) + CASE WHEN st = 'HYBRID' THEN coalesce(1.0::DOUBLE / (60 + s), 0) ELSE 0 END, 9) AS DOUBLE) AS score FROM b WHERE st = 'HYBRID' OR l IS NOT NULL)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score, state FROM f QUALIFY rank <= 3""")  # fmt: skip
def hybrid_with_fallbacks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    own = lambda *order: F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("rank")
    side = lambda where, *order: c.where(where).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), own(*order))
    i = F.col("query_id") % 5
    states = c.select(F.col("conv_id").alias("query_id")).distinct().where(i < 4)
    states = states.select("query_id", F.when(i == 0, R.HYBRID_STATES["stale"]).when(i == 1, R.HYBRID_STATES["provider_error"]).otherwise(R.HYBRID_STATES["ready"]).alias("state"))
    return R.hybrid_many(side("turn % 3 < 2", F.desc(F.length("text")), "turn"), side("turn % 3 > 0", F.length("text"), "turn"), states, top_k=3)


@query("""SELECT conv_id AS query_id, turn AS id, turn + 1 AS rank, 'RERANK_FALLBACK_UNCONFIGURED' AS state FROM conversations WHERE conv_id % 2 = 0 AND turn < 5
    UNION ALL SELECT DISTINCT conv_id, NULL, NULL, 'RERANK_FALLBACK_NO_CANDIDATES' FROM conversations WHERE conv_id % 2 = 1""")  # fmt: skip
def rerank_without_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), (F.col("turn") + 1).alias("hybrid_rank"), F.length("text").cast("double").alias("score"))
    return R.reranked_or_not(c.where("query_id % 2 = 0").drop("score"), c.drop("hybrid_rank"), configured=False, queries=c)


_RERANK = """c AS (SELECT conv_id AS query_id, turn AS id, turn + 1 AS hybrid_rank, CAST(length(text) AS DOUBLE) AS s FROM conversations),
    g AS (SELECT *, query_id % 3 = 0 AS good, query_id % 3 = 1 AND id > 0 OR query_id % 3 = 0 AS given FROM c), a AS (SELECT query_id, bool_or(given) AS one, bool_and(given) AS whole FROM g GROUP BY 1)"""


@query(f"""WITH {_RERANK} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN whole THEN s END DESC NULLS LAST, hybrid_rank) AS rank,
    CASE WHEN NOT one THEN 'RERANK_FALLBACK_PROVIDER_ERROR' WHEN whole THEN 'RERANKED' ELSE 'RERANK_FALLBACK_INVALID_RESPONSE' END AS state FROM g JOIN a USING (query_id) QUALIFY rank <= 5""")  # fmt: skip
def rerank_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), (F.col("turn") + 1).alias("hybrid_rank"), F.length("text").cast("double").alias("score"))
    given = c.where("query_id % 3 = 0 OR (query_id % 3 = 1 AND id > 0)").select("query_id", "id", "score")
    return R.reranked_or_not(c.select("query_id", "id", "hybrid_rank"), given)


_SYNC = """s AS (SELECT doc_id AS reference_id, sha256(text) AS fingerprint, doc_id % 11 <> 0 AS is_current, 1 AS run_id FROM documents WHERE doc_id % 3 < 2),
    w AS (SELECT doc_id AS reference_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS fingerprint FROM documents WHERE doc_id % 3 > 0),
    y AS (SELECT coalesce(s.reference_id, w.reference_id) AS reference_id, coalesce(w.fingerprint, s.fingerprint) AS fingerprint, w.reference_id IS NOT NULL AS is_current, CASE WHEN w.reference_id IS NULL THEN run_id ELSE 2 END AS run_id,
    CASE WHEN w.reference_id IS NULL THEN CASE WHEN is_current THEN 'delete' ELSE 'keep' END WHEN s.reference_id IS NULL THEN 'insert' WHEN s.fingerprint = w.fingerprint THEN 'touch' WHEN NOT is_current THEN 'insert' ELSE 'replace' END AS action FROM s FULL JOIN w USING (reference_id))"""


def after_sync(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    stored = d.where("doc_id % 3 < 2").select(i.alias("reference_id"), sha256_text(F.col("text")).alias("fingerprint"), (i % 11 != 0).alias("is_current"), F.lit(1).cast("long").alias("run_id"))
    wanted = d.where("doc_id % 3 > 0").select(i.alias("reference_id"), sha256_text(F.when(i % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("fingerprint"))
    return R.synced(stored, wanted, 2)


@query(f"WITH {_SYNC} SELECT * FROM y")
def corpus_sync(spark, sf_dir):
    return after_sync(spark, sf_dir)


@query(f"WITH {_SYNC} SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'touch') AS reused, count(*) FILTER (WHERE action = 'replace') AS replaced, count(*) FILTER (WHERE action = 'delete') AS removed, count(*) FILTER (WHERE is_current) AS current FROM y")
def corpus_sync_counters(spark, sf_dir):
    return R.sync_counters(after_sync(spark, sf_dir))


@query("""SELECT c_custkey, arg_min(c_name, CAST(c_name = 'new' AS INT)) AS c_name, max(seen_at) AS seen_at FROM (SELECT c_custkey, c_name, TIMESTAMP '1990-01-01' AS seen_at FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT o_custkey, 'new', max(o_orderdate) FROM orders GROUP BY 1, 2) GROUP BY c_custkey""")  # fmt: skip
def profile_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", F.to_timestamp(F.lit("1990-01-01")).alias("seen_at"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("new").alias("c_name"), F.max("o_orderdate").cast("timestamp").alias("seen_at"))
    return R.upserted(c, new.select("c_custkey", "c_name", "seen_at"), "c_custkey", "seen_at")


@query("""SELECT l_orderkey AS run_id, arg_max(CASE WHEN l_linenumber = 1 THEN 'RUNNING' WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END, (l_shipdate, l_linenumber)) AS status, min(l_shipdate) AS started_at,
    max(l_shipdate) FILTER (WHERE l_linenumber > 1) AS finished_at, count(*) AS n_entries FROM lineitem GROUP BY 1""")  # fmt: skip
def run_ledger(spark, sf_dir):
    status = F.when(F.col("l_linenumber") == 1, "RUNNING").when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), status.alias("status"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("seq"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return R.ledger(rows, place="place", ends="seq > 1")


_LEN = lambda c: f"unhex(lpad(to_hex(strlen({c})), 16, '0')) || encode({c})"


@query(f"WITH {_REFS} SELECT reference_id, sha256({' || '.join(_LEN(c) for c in ('source_kind', 'path', 'title', 'symbol', 'CAST(start_line AS VARCHAR)', 'chunk_id'))}) AS fingerprint FROM (SELECT * REPLACE (coalesce(source_kind, '') AS source_kind) FROM r)")
def reference_fingerprints(spark, sf_dir):
    r = references(spark, sf_dir)
    return r.select("reference_id", R.reference_fingerprint(*(F.col(c) for c in ("source_kind", "path", "title", "symbol", "start_line", "chunk_id"))).alias("fingerprint"))


@query("""WITH h AS (SELECT source, md5(doc_id || '|' || sha256(text)) AS h FROM documents)
    SELECT source, count(*) AS n, md5(CAST(sum(('0x' || left(h, 15))::BIGINT::HUGEINT) AS VARCHAR) || '|' || CAST(sum(('0x' || substring(h, 17, 15))::BIGINT::HUGEINT) AS VARCHAR)) AS fingerprint FROM h GROUP BY source""")  # fmt: skip
def inventory_fingerprints(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", sha256_text(F.col("text")).alias("h"))
    return R.inventory_fingerprint(d, "source", "doc_id", "h")


@query("SELECT user_id % 10 AS project_id, count(*) AS leaked FROM events WHERE event_id % 13 = 0 GROUP BY 1")
def isolation_probe(spark, sf_dir):
    """Every project asks for its rows; each thirteenth is another project's, planted here, and must be told."""
    e = table(spark, sf_dir, "events")
    shown = e.select((F.col("user_id") % 10).alias("project_id"), F.col("event_id").alias("reference_id"))
    grants = shown.select(F.when(F.col("reference_id") % 13 == 0, (F.col("project_id") + 1) % 10).otherwise(F.col("project_id")).alias("project_id"), "reference_id")
    return R.leaks(shown, grants)
