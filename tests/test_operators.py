import random
import re

from brightloom.functions import columns as C
from brightloom.operators import corpus, events, memory, retrieval
from pyspark.sql import functions as F


def test_line_windows():
    text = "".join(f"line {i}: retrieval\n" for i in range(1, 121))
    assert [w[:2] for w in corpus.line_windows(text)] == [(1, 80), (71, 120)]
    long = list(corpus.line_windows("x" * 12_100))
    assert len(long) >= 3 and all(e - s <= 6000 and a == b == 1 for a, b, s, e in long) and long[-1][3] == 12_100
    assert list(corpus.line_windows("")) == [] and list(corpus.line_windows("one\ntwo")) == [(1, 2, 0, 7)]
    rnd = random.Random(3)
    for _ in range(50):
        t = "".join(rnd.choice("ab\n") * rnd.choice([1, 1, 1, 300]) for _ in range(rnd.randint(0, 300)))
        seen = set().union(*(range(s, e) for _, _, s, e in corpus.line_windows(t, 5, 400, 2, 50)), ())
        assert len(seen) == len(t)


def test_chunks_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a\nb", 0), (3, "a\nb", 0)], "doc_id long, text string, ordinal long")
    assert sorted((r.doc_id, r.start_char, r.end_char) for r in corpus.chunks(df).collect()) == [(3, 0, 3)] * 2
    assert corpus.chunks(df.limit(0)).count() == 0


def test_cover_density():
    def plain(places):
        every = sorted({p for ps in places for p in ps})
        covers = [(a, b) for a in every for b in every if a <= b and all(any(a <= p <= b for p in ps) for ps in places)]
        least = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
        return sum(0.1 / (1 + b - a + 1 - len(places)) for a, b in least)

    rnd = random.Random(5)
    for _ in range(200):
        at = rnd.sample(range(30), 12)
        places = [sorted(at[:4]), sorted(at[4:7]), sorted(at[7:])]
        assert abs(retrieval.cover_density(places) - plain(places)) < 1e-9


def test_identifier_tokens(spark):
    df = spark.createDataFrame([("backend/app/OrderService.get_project-value",), ("HTTPServer2",), ("Straße",)], "s string")
    got = [r[0] for r in df.select(C.identifier_tokens(F.col("s"))).collect()]
    assert got == ["backend app order service get project value".split(), ["http", "server", "2"], ["stra", "e"]]


def test_blob_and_tokens(spark):
    r = spark.createDataFrame([("hello\n", "éàüöï", "")], "a string, b string, c string")
    got = r.select(C.git_blob_sha1(F.col("a").cast("binary")), C.token_estimate(F.col("b")), C.token_estimate(F.col("c"))).first()
    assert tuple(got) == ("ce013625030ba8dba906f756967f9e9ca394464a", 3, 0)


def test_fusion_adds_reciprocal_ranks(spark):
    lex = spark.createDataFrame([("a", 1), ("b", 2)], "id string, lexical_rank long")
    sem = spark.createDataFrame([("a", 2), ("c", 1)], "id string, semantic_rank long")
    got = {r.id: r.score for r in retrieval.hybrid(lex, sem).collect()}
    assert got == {"a": round(1 / 61 + 1 / 62, 9), "b": round(1 / 62, 9), "c": round(1 / 61, 9)}
    assert [r.id for r in retrieval.hybrid(lex, sem.limit(0)).collect()] == ["a", "b"]


def test_map_diff_round_trip(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c/d": None})], "o map<string,string>, n map<string,string>")
    ops = [tuple(x) for x in df.select(memory.map_diff(F.col("o"), F.col("n"))).first()[0]]
    assert ops == [("remove", "/a", None), ("add", "/c~1d", None), ("replace", "/b", "3")]


def test_missing_metrics_are_not_zero(spark):
    none = spark.createDataFrame([(1, None, None)], "g long, value double, provenance string")
    assert tuple(events.summed(none, "g").first()) == (1, None, "UNAVAILABLE")
    assert tuple(events.cache_rates(spark.createDataFrame([(1, "x")], "g long, event_type string"), "g").first()) == (1, 0, 0, None)


def test_conflicting_emission_is_an_error(spark):
    df = spark.createDataFrame([(1, "k", "a", 1), (1, "k", "b", 2)], "project_id long, emission_key string, content string, ordering_id long")
    try:
        events.deduplicated(df).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "different contents" in str(e)


def test_search_of_several_words_by_brute_force(spark):
    from brightloom.operators import references as R

    rows = [(i, f"c{i % 4}", "TASK" if i % 3 == 0 else "md", i % 2 or None, f"docs/a{i}.md", f"t{i % 5}", f"m.f{i}", i, " ".join(random.Random(i).choices(["red", "blue", "x", "y", "t1"], k=i % 12))) for i in range(80)]
    refs = spark.createDataFrame(rows, "reference_id long, chunk_id string, source_kind string, task_id long, path string, title string, symbol string, start_line long, content string")
    want = {}
    for i, chunk, kind, task, path, title, symbol, _, content in rows:
        cut = lambda t: re.findall(r"[a-z0-9]+", t.lower())
        score, hit = 0.0, False
        for weight, w in ((1.0, cut(content)), (1.5, cut(f"{path} {title} {symbol}"))):
            places = [[k for k, x in enumerate(w) if x == t] for t in ("red", "blue")]
            if all(places):
                hit, score = True, score + weight * retrieval.cover_density(places)
        if hit:
            key = (kind, chunk if kind == "TASK" else i)
            want[key] = min(want.get(key, (0, True, 0, 0)), (-round(score, 6), task is None, task or 0, i))
    got = R.search(refs, "red blue", top_k=None).collect()
    assert {r.reference_id for r in got} == {w[3] for w in want.values()} and len(got) > 10
    assert R.search(refs.limit(0), "red blue").count() == 0


def test_exact_names_outrank_words(spark):
    from brightloom.operators import references as R

    rows = [(1, "c", "md", None, "docs/Setup.md", "Setup", "m.read", 0, "x"), (2, "c", "md", None, "a/setup", "s", "setup", 0, "y"), (3, "c", "md", None, "z", "z", "setup.go", 0, "no"), (4, "c", "md", None, "z", "z", "z", 0, "setup setup")]
    refs = spark.createDataFrame(rows, "reference_id long, chunk_id string, source_kind string, task_id long, path string, title string, symbol string, start_line long, content string")
    assert [(r.reference_id, r.score) for r in R.search(refs, " SETUP ").collect()] == [(2, 6.6), (1, 2.1), (3, 1.3), (4, 0.4)]  # words count as such and as pieces


def test_rerank_states_and_strict_mode(spark):
    from brightloom.operators import references as R

    c = spark.createDataFrame([(q, i, i) for q in range(4) for i in (1, 2, 3)], "query_id long, id long, hybrid_rank long")
    s = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (0, 3, 0.1), (1, 1, 1.0), (1, 2, float("nan")), (1, 3, 0.2), (3, 1, 1.0), (3, 1, 1.0), (3, 2, 0.0), (3, 3, 0.5)], "query_id long, id long, score double")
    got = {q: [(r.id, r.state) for r in sorted(R.reranked_or_not(c, s).where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in range(4)}
    assert got[0] == [(i, "RERANKED") for i in (2, 1, 3)]
    assert got[1] == got[3] == [(i, "RERANK_FALLBACK_INVALID_RESPONSE") for i in (1, 2, 3)]
    assert got[2] == [(i, "RERANK_FALLBACK_PROVIDER_ERROR") for i in (1, 2, 3)]
    assert {r.query_id for r in R.reranked_or_not(c, s, strict=True).collect()} == {0}
    assert {r.state for r in R.reranked_or_not(c, s, enabled=False).collect()} == {"RERANK_FALLBACK_DISABLED"}


def test_recall_counts_what_is_nowhere_returned(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five six"), (2, "a b c"), (3, "x one two three four five y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ne two three four fi"), (2, "none of these words is there"), (3, "b")], "item_id long, text string")
    assert sorted(map(tuple, retrieval.containing(docs, items).collect())) == [(1, 1), (1, 3), (3, 2)]
    found = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 2, 1)], "item_id long, doc_id long, rank long")
    asked = spark.createDataFrame([(1, True), (2, True), (3, False)], "item_id long, critical boolean")
    r = retrieval.evaluation(found, retrieval.containing(docs, items), asked).first()
    assert tuple(r) == (3, 0.3333, 0.0, 0.1667, 0.3333, 1)


def test_required_context_over_the_budget_is_an_error(spark):
    rows = [(1, 0, "a" * 40_000, True), (1, 1, "b", False), (2, 0, "c", True), (2, 1, "d" * 20_000, False), (2, 2, "e" * 20_000, False)]
    got = retrieval.adaptive_budget(spark.createDataFrame(rows, "g long, o long, t string, must boolean"), "g", "o", "t", "must", F.lit(4096)).collect()
    assert {(r.g, r.o): (r.kept, r.error) for r in got} == {
        (1, 0): (False, "required_context_exceeds_token_budget"), (1, 1): (False, "required_context_exceeds_token_budget"), (2, 0): (True, None), (2, 1): (False, None), (2, 2): (False, None)
    }


def test_path_mentions_and_text_rules(spark):
    from brightloom.functions import text as X
    from brightloom.operators import code

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.canonical_path(F.lit("a\\.\\b//c.py"))) == "a/b/c.py" and all(one(X.canonical_path(F.lit(p))) is None for p in ("/a", "C:\\a", "a/../b", ""))
    assert one(X.symbol_mentions(F.lit("see a.b.run, x@y.com, www.site.org, example.dev, docs.vendor.tech.reader, m.py, my_x.io.y and core.load."))) == ["a.b.run", "core.load", "my_x.io.y"]
    assert one(X.strict_base64(F.lit("YWI="))) == b"ab" and one(X.strict_base64(F.lit("YWI"))) is None
    assert one(code.mentioned_paths(F.lit("in src/a.py, ./b/c.d.ts and x/y; not /abs.md but docs/read-me.md docs/read-me.md"))) == ["./b/c.d.ts", "docs/read-me.md", "src/a.py"]


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    from brightloom.streaming import events as stream

    at, into = str(tmp_path / "in"), str(tmp_path / "out")
    count = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.createDataFrame([(1, "a"), (2, "a"), (2, "a")], "event_id long, k string").coalesce(1).write.parquet(at)
    fold = lambda: {tuple(r) for r in stream.fold(spark, at, lambda df: df, count, "event_id", into).collect()}
    assert fold() == {("a", 2)} and fold() == {("a", 2)}
    spark.createDataFrame([(2, "a"), (3, "b")], "event_id long, k string").coalesce(1).write.mode("append").parquet(at)
    assert fold() == {("a", 2), ("b", 1)}
