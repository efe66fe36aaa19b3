import random

import pytest
from pyspark.sql import functions as F

from brightloom.functions.columns import words
from brightloom.operators import postings, retrieval
from brightloom.operators import references as R
from brightloom.session import shared_folder

REFS = "reference_id long, chunk_id string, source_kind string, task_id long, path string, title string, symbol string, start_line long, content string"


def some_refs(n, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{c}" for c in "abcdefghij"] + ["OrderService", "get_project", "HTTPServer2", "straße"]
    weights = [2 ** -(i / 2) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        content = " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 25)))
        kind = rnd.choice(["TASK", "CODE", None])
        symbol = rnd.choice(["OrderService.get_project", "wa.wb", "wa", None])
        rows.append((i, f"c{i % 40}" if kind == "TASK" else f"c{i}", kind, rnd.choice([None, 1, 2]), rnd.choice(["src/wa.py", "wa", "a/wb", None]), rnd.choice(["wa", "Wb wc", None]), symbol, i % 3, content or None))
    return rows


@pytest.mark.parametrize(("block", "first"), [(4096, 4), (20, 1)])
def test_index_finds_what_a_scan_finds(spark, monkeypatch, block, first):
    monkeypatch.setattr(postings, "FIRST_BLOCKS", first)
    refs = spark.createDataFrame(some_refs(300), REFS).withColumn("clash", F.lit(1))
    queries = ["order service", "wa", "WB", "wa wb", "wa.wb", "OrderService.get_project", "wa wb wc", "http server 2", "straße", "nowhere wa", "wj wi", "wa wb wc wd", "wa wb wc wd we", "src/wa.py", "a\\wb", " ", None, "x" * 513, "!!"]
    index = postings.build_references(refs, block=block)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {}
    for r in postings.search_references(spark, index, asked, top_k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.reference_id, r.score))
    for i, q in enumerate(queries):
        try:
            want = [(n + 1, r.reference_id, r.score) for n, r in enumerate(R.search(refs, q or "", top_k=7).collect())]
        except ValueError:
            want = []
        assert sorted(got.get(i, [])) == want, q
    assert got[0] and got[7] and got[8]
    faults = {r.query_id: r.fault for r in postings.normalised_queries(asked).collect() if r.fault}
    assert faults == {15: "blank", 16: "blank", 17: "long", 18: "no_words"}


def test_identifiers_are_found_by_their_pieces(spark):
    refs = spark.createDataFrame([(1, "c", "CODE", None, None, None, "OrderService.get_project", 1, None), (2, "d", "CODE", None, None, None, "other", 1, "")], REFS)
    assert [r.reference_id for r in R.search(refs, "order service").collect()] == [1]
    assert retrieval.query_tokens("backend/app/OrderService.get_project-value") == ["backend", "app", "order", "service", "get", "project", "value"]
    q = spark.createDataFrame([(1, "backend/app/OrderService.get_project-value")], "query_id int, query string")
    r = postings.normalised_queries(q).first()
    assert r.tokens == retrieval.query_tokens("backend/app/OrderService.get_project-value") and r.basename == "orderservice.get_project-value"


def test_index_of_nothing(spark):
    refs = spark.createDataFrame(some_refs(5), REFS)
    asked = spark.createDataFrame([(1, "wa")], "query_id int, query string")
    assert postings.search_references(spark, postings.build_references(refs.limit(0)), asked).count() == 0
    assert postings.search_references(spark, postings.build_references(refs), asked.limit(0)).count() == 0


@pytest.mark.parametrize("first", [1, 3, 50, 2])
def test_overlap_is_brute_force(spark, first):
    rnd = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = {i: " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 30))) for i in range(300)}
    items = {i: " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 12))) for i in range(30)} | {30: "v0", 31: "zz", 32: "v59 v58 v0 zz"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string").select("item_id", F.array_distinct(words(F.col("text"))).alias("terms"))
    terms = F.array_distinct(words(F.col("text")))
    index = postings.unindexed(docs, terms) if first in (2, 50) else postings.build(docs, shared_folder(spark, "words"), terms, block=50)
    got = {}
    for r in postings.search_overlap(spark, index, asked, top_k=5, first=first).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.overlap))
    for i, t in items.items():
        shared = sorted((-len(set(t.split()) & set(x.split())), d) for d, x in texts.items() if set(t.split()) & set(x.split()))[:5]
        assert sorted(got.get(i, [])) == [(n + 1, d, -s) for n, (s, d) in enumerate(shared)]
