"""Queries of a corpus in generations: what each published, what is current in each, and what became of the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generations as G
from ..session import shared_folder
from .registry import query, table


def sources(spark, sf_dir, n: int) -> DataFrame:
    """The sources of the n-th run: documents as files, symbols or tasks, some left out and some changed; the second run meets one that can't be read."""
    i = F.col("doc_id")
    text = F.left("text", F.lit(200))
    text = text if n == 1 else F.when(i % 5 == 0, F.concat(text, F.lit("!"))).otherwise(text)
    text = F.when(i % 97 == 1, F.raise_error(F.lit("broken source")).cast("string")).otherwise(text) if n == 2 else text
    d = table(spark, sf_dir, "documents").where({1: "doc_id % 3 < 2", 2: "doc_id % 3 > 0", 3: "doc_id % 3 > 0", 4: "doc_id % 3 > 0 AND doc_id % 7 > 0 OR doc_id % 3 = 0 AND doc_id % 2 = 0"}[n])
    d = d.select(i.cast("string").alias("source_id"), F.concat("source", F.lit("/"), i.cast("string")).alias("path"), F.col("lang").alias("title"), text.alias("text"), (i % 4).alias("_k"))
    return G.united(*[d.where(k).drop("_k") for k in ("_k = 0", "_k = 1", "_k > 1")])


def synced(spark, sf_dir) -> str:
    path = shared_folder(spark, "generations")
    for n in (1, 2, 3, 4):
        try:
            G.sync(spark, path, sources(spark, sf_dir, n), f"run{n}", f"2026-01-0{n}T00:00:00Z")
        except Exception:
            if n != 2:
                raise
    return path


@query("""WITH d AS (SELECT doc_id AS i, left(text, 200) AS t FROM documents WHERE text IS NOT NULL),
    w AS (SELECT 1 AS g, i, t FROM d WHERE i % 3 < 2 UNION ALL SELECT 2, i, CASE WHEN i % 5 = 0 THEN t || '!' ELSE t END FROM d WHERE i % 3 > 0
        UNION ALL SELECT 3, i, CASE WHEN i % 5 = 0 THEN t || '!' ELSE t END FROM d WHERE i % 3 > 0 AND i % 7 > 0 OR i % 3 = 0 AND i % 2 = 0),
    x AS (SELECT w.*, c.t IS NULL AS new_chunk, p.i IS NULL AS new_ref FROM w LEFT JOIN (SELECT t, min(g) AS first FROM w GROUP BY t) c ON c.t = w.t AND c.first < w.g LEFT JOIN w p ON p.g = w.g - 1 AND p.i = w.i AND p.t = w.t WHERE w.t <> ''),
    n AS (SELECT g, count(*) AS refs, count(*) FILTER (WHERE i % 4 > 1) AS tasks, count(DISTINCT t) AS chunks, count(DISTINCT t) FILTER (WHERE new_chunk) AS new_chunks, count(*) FILTER (WHERE new_ref) AS new_refs FROM x GROUP BY g)
    SELECT g AS generation, CASE g WHEN 1 THEN 'run1' WHEN 2 THEN 'run3' ELSE 'run4' END AS run_id, chunks, new_chunks, chunks - new_chunks AS reused_chunks, refs AS references, refs - tasks AS repository_references, tasks AS task_references,
        new_refs AS new_references, refs - new_refs AS reused_references, coalesce(lag(refs) OVER (ORDER BY g), 0) - (refs - new_refs) AS removed_references FROM n""".replace("AS references", 'AS "references"'))  # fmt: skip
def corpus_generations(spark, sf_dir):
    return G.manifests(spark, synced(spark, sf_dir)).drop("at", "repository_fingerprint", "task_fingerprint", "fingerprint")


@query("""WITH d AS (SELECT doc_id AS i, source, left(text, 200) AS t FROM documents WHERE text <> '')
    SELECT i::VARCHAR AS source_id, source || '/' || i AS path, CASE i % 4 WHEN 0 THEN 'REPOSITORY_FILE' WHEN 1 THEN 'REPOSITORY_SYMBOL' ELSE 'TASK' END AS source_kind, sha256(CASE WHEN i % 5 = 0 THEN t || '!' ELSE t END) AS chunk FROM d WHERE i % 3 > 0""")  # fmt: skip
def corpus_as_of_generation(spark, sf_dir):
    return G.as_of(spark, synced(spark, sf_dir), 2).select("source_id", "path", "source_kind", "chunk")


@query("SELECT 'run' || n AS run_id, CASE WHEN n = 2 AND (SELECT count(*) FROM documents WHERE doc_id % 97 = 1 AND doc_id % 3 > 0) > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM range(1, 5) t(n)")
def corpus_run_ledger(spark, sf_dir):
    rows = G.ledger(spark, synced(spark, sf_dir))
    return rows.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"))
