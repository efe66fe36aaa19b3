"""Queries of vectors from a provider: what runs sent, and what is stored. The provider is an offline one that counts letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sha256_text
from ..operators import inference as I
from ..session import shared_folder
from .registry import query, table

PROFILE = I.Profile("offline", "letters", "1", 3)


class Letters:
    """How often a, e and t are in a text; answers come in reverse order, with their indexes."""

    def embed(self, texts):
        return [(i, [float(t.count(c)) for c in "aet"]) for i, t in reversed(list(enumerate(texts)))]


def synced(spark, sf_dir) -> str:
    """Two runs over documents: the second after every fifth has changed and some are new."""
    path = shared_folder(spark, "semantic")
    d = table(spark, sf_dir, "documents")
    for n, (where, text) in enumerate((("doc_id % 4 > 0", F.col("text")), ("doc_id % 3 > 0", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" tea"))).otherwise(F.col("text"))))):
        rows = d.where(where).select(F.col("doc_id").alias("chunk_id"), text.alias("content"), sha256_text(text).alias("content_sha256"))
        I.sync(spark, path, rows, Letters(), PROFILE, f"run{n + 1}", 16)
    return path


_RUNS = """a AS (SELECT doc_id AS i, text AS t FROM documents WHERE doc_id % 4 > 0 AND text IS NOT NULL), b AS (SELECT doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN text || ' tea' ELSE text END AS t FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL),
    k AS (SELECT b.*, a.i IS NOT NULL AS known FROM b LEFT JOIN a ON a.i = b.i AND a.t = b.t)"""


@query(f"""WITH {_RUNS} SELECT 'run1' AS run_id, 'COMPLETED' AS status, count(*) AS current, count(*) AS new, 0::BIGINT AS reused, 0::BIGINT AS failed_batches FROM a
    UNION ALL SELECT 'run2', 'COMPLETED', count(*), count(*) FILTER (WHERE NOT known), count(*) FILTER (WHERE known), 0 FROM k""")  # fmt: skip
def embedding_runs(spark, sf_dir):
    return I.runs(spark, synced(spark, sf_dir)).drop("requests", "error")


@query(f"""WITH {_RUNS}, e AS (SELECT i, t FROM a UNION ALL SELECT i, t FROM k WHERE NOT known), n AS (SELECT *, [length(t) - length(replace(t, c, '')) for c in ['a', 'e', 't']] AS x FROM e)
    SELECT i::VARCHAR AS chunk_id, sha256(t) AS content_sha256, x[1]::DOUBLE AS a, x[2]::DOUBLE AS e, x[3]::DOUBLE AS t FROM n""")  # fmt: skip
def embedding_vectors(spark, sf_dir):
    v = I.vectors(spark, synced(spark, sf_dir), PROFILE)
    return v.select("chunk_id", "content_sha256", *[F.col("embedding")[n].alias(c) for n, c in enumerate("aet")])
