"""Queries over the shared tables, one per operator, with production parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, exact_dedup, fingerprint, langid, license_scan, maxscore, mixing, packing, quality, secrets, simhash, sort_means, toxicity
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.notices(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op9_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_structural_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster(table(spark, sf_dir, "embeddings"))


def op13_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.nearest_by_product(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kneser_ney_quality, op2_noisy_channel_toxicity, op3_minhash_license_scan, op4_simhash_near_dedup, op5_multiset_fingerprint,
        op6_exact_dedup, op7_rank_order_language, op8_source_mixing, op9_length_packing, op10_structural_secret_scan, op11_maxscore_search, op12_sort_means, op13_ball_tree_topk,
    )
}

def sort_means_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """Every round as two steps: the nearest centroid of each vector among all, then the floor of the means."""
    near = lambda r: f"""
        a{r} AS MATERIALIZED (
            SELECT vec_id, x, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d
            FROM (SELECT v.*, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r} c) GROUP BY vec_id, x
        )"""  # noqa: E731
    means = lambda r: f"""
        c{r + 1} AS MATERIALIZED (
            SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (
                SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS m
                FROM (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY c, i) GROUP BY c
            ) n USING (c)
        )"""  # noqa: E731
    steps = ",".join(near(r) + "," + means(r) for r in range(rounds)) + "," + near(rounds)
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        ),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS m FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k})
        ),{steps}
        SELECT a.vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (c)
    """


ORACLE_SQL = {
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op11_maxscore_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
        s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
        q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ),
        r AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 20
    """,
    "op12_sort_means": sort_means_sql(),
    "op13_ball_tree_topk": """
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
    """,
}
