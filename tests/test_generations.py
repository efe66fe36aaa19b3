import pytest
from pyspark.sql import functions as F

from brightloom.operators import generations as G
from brightloom.operators import references as R

SIDE = "source_id string, path string, text string"


def sources(spark, files=(), symbols=(), tasks=()):
    return G.united(*[spark.createDataFrame(list(x), SIDE) for x in (files, symbols, tasks)])


def current(spark, path, n=None):
    return sorted((r.source_kind, r.source_id, r.ordinal) for r in G.as_of(spark, path, n).collect())


def test_three_generations_one_of_them_failed(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert G.as_of(spark, path).count() == 0 and G.history(spark, path).count() == 0 and G.chunk_texts(spark, path).count() == 0
    long = "".join(f"line {i}\n" for i in range(120))
    one = sources(spark, [("1", "a.py", long), ("2", "b.py", "same"), ("3", "c.py", ""), ("4", "d.py", None)], [("5", "a.py", "same")], [("6", None, "task"), ("6", None, "task")])
    a = G.sync(spark, path, one, "r1", "2026-01-01T00:00:00Z")
    assert (a["references"], a["task_references"], a["chunks"], a["new_references"], a["removed_references"]) == (5, 1, 4, 5, 0)
    two = sources(spark, [("1", "a.py", long), ("2", "b.py", "other")], [("5", "a.py", "same")], [("7", None, "task")])
    with pytest.raises(Exception, match="broken"):
        G.sync(spark, path, two.withColumn("text", F.when(F.col("source_id") == "7", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("text"))), "r2", "2026-01-02T00:00:00Z")
    assert current(spark, path) == current(spark, path, 1) and G.manifests(spark, path).count() == 1
    b = G.sync(spark, path, two, "r3", "2026-01-03T00:00:00Z")
    assert (b["generation"], b["references"], b["new_references"], b["reused_references"], b["removed_references"], b["new_chunks"], b["reused_chunks"]) == (2, 5, 2, 3, 2, 1, 4)
    assert b["repository_fingerprint"] != a["repository_fingerprint"] and b["fingerprint"] != a["fingerprint"]
    c = G.sync(spark, path, one.repartition(5), "r4", "2026-01-04T00:00:00Z")
    assert (c["fingerprint"], c["new_chunks"], c["new_references"], c["removed_references"]) == (a["fingerprint"], 0, 2, 2)
    assert current(spark, path, 1) == current(spark, path, 3) == current(spark, path) != current(spark, path, 2)
    assert ("TASK", "7", 0) in current(spark, path, 2) and ("TASK", "7", 0) not in current(spark, path, 3)
    texts = {r.chunk: r.content for r in G.chunk_texts(spark, path).collect()}
    assert {"same", "other", "task"} < set(texts.values()) and all(r.chunk in texts for r in G.as_of(spark, path, 2).collect())
    assert {(r.generation, r.action) for r in G.history(spark, path).where("source_id = '7'").collect()} == {(2, "insert"), (3, "delete")}
    with pytest.raises(Exception):
        G.sync(spark, path, two, "r4", "2026-01-05T00:00:00Z")  # a run id is used once
    runs = G.ledger(spark, path).groupBy("run_id").agg(F.max_by("status", "seq").alias("status"))
    assert {r.run_id: r.status for r in runs.collect()} == {"r1": "COMPLETED", "r2": "FAILED", "r3": "COMPLETED", "r4": "COMPLETED"}
    state = R.corpus_states(spark.createDataFrame([(1,)], "project_id int"), G.ledger(spark, path).where("seq = 1").selectExpr("1 AS project_id", "run_id", "status", "at AS started_at", "at AS completed_at"))
    assert state.first().state == "CURRENT"


def test_an_empty_corpus_is_a_generation(spark, tmp_path):
    path = str(tmp_path / "corpus")
    G.sync(spark, path, sources(spark, [("1", "a.py", "x")]), "r1", "2026-01-01T00:00:00Z")
    m = G.sync(spark, path, sources(spark), "r2", "2026-01-02T00:00:00Z")
    assert (m["references"], m["removed_references"], m["chunks"]) == (0, 1, 0) and current(spark, path) == []
