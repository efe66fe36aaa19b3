"""Work grows with the rows and not with their pairs: rows shuffled are counted."""

import ast
import re

from pyspark.sql import functions as F

from brightloom.operators import code, evidence, postings
from brightloom.operators import references as R
from brightloom.plans import code as code_queries


def shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def rows_of(spark, df):
    before = set(shuffled(spark))
    got = [tuple(r) for r in df.collect()]
    return got, sum(n for k, n in shuffled(spark).items() if k not in before)


def test_whole_files_of_a_name_that_every_file_defines(spark):
    n = 400
    tasks = spark.range(n).select(F.col("id").alias("task_id"), F.lit("p").alias("project_id"), F.lit("Show Part.size whole").alias("wanted"))
    found = F.when(F.col("id") % 2 == 0, F.concat(F.lit("f/"), F.col("id") + 1000)).otherwise("not/there.py")
    items = spark.range(n).select(F.col("id").alias("task_id"), F.lit("file").alias("kind"), F.lit(0).alias("order"), found.alias("path"))
    files = spark.range(1000, 1000 + n).select(F.lit("p").alias("project_id"), F.concat(F.lit("f/"), "id").alias("path"))
    names = files.select("project_id", "path", F.lit("Part.size").alias("name"), F.lit("size").alias("short"), F.lit(1).alias("line"))
    got, rows = rows_of(spark, evidence.complete_files(tasks, items, files, names, 2)[0])
    assert sorted(got) == sorted([(i, 1, f"f/{i + 1000}") for i in range(0, n, 2)] + [(i, r, f"f/{999 + r}") for i in range(1, n, 2) for r in (1, 2)])
    assert rows < 60 * n  # n * n before


def test_tests_linked_to_modules_by_brute_force_without_pairs(spark):
    stems = [f"mod_{i}" for i in range(1, 600)] + ["a", "_1", "été", "x.y", "t_m", "mod_1", "test_mod_77.py", "py", "zz"]
    modules = [f"src/{i % 2}/{s}.py" for i, s in enumerate(stems)] + ["src/.hidden", "src/"]
    tests = [f"tests/test_mod_{i}.py" for i in range(1, 900)] + ["a", "tests/été_x.y.py", "tests/aaa", ""]
    df = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1)
    got, rows = rows_of(spark, code.linked_tests(df(modules), df(tests)))
    stem_of = lambda p: (lambda s: s[: s.rindex(".")] if s.rfind(".") > 0 else s)(p.rpartition("/")[2])
    want = [(m, t, r) for m in set(modules) if stem_of(m) for r, t in enumerate(sorted(t for t in tests if stem_of(m) in t)[:8], 1)]
    assert sorted(got) == sorted(want)
    assert rows < 20 * (len(modules) + len(tests))


def test_sources_are_dealt_over_tasks_and_structure_is_counted(spark):
    assert code_queries.sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    text = "class A(B):\n    def f(self):\n        def g(): pass\n    class C: pass\nif 1:\n    def h(): pass\n"
    files = spark.createDataFrame([("a", text), ("b", "x = 1"), ("c", "def :"), ("d", "async def k(): pass")], "path string, source string")
    want = sorted(tuple(r) for r in code.module_summaries(code.outlines(files)).collect())
    assert sorted(tuple(r) for r in code.module_structures(files).collect()) == want
    assert list(code.structure_rows(ast.parse(text))) == [tuple(want[0][1:])]


def test_texts_are_cut_into_words_once(spark):
    """What a filter or a lambda repeats is cut again: the plan names the cutting once."""
    from brightloom.operators import retrieval

    docs = spark.createDataFrame([(1, "The cat and the dog of Rome", "en", "s"), (2, "the and", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    times = lambda df, cut: df._jdf.queryExecution().optimizedPlan().toString().count(cut)
    several = retrieval.lexical(docs, "the and of", top_k=None)
    assert times(several, "[\\p{L}\\p{N}]+") == 1 and [r.doc_id for r in several.collect()] == [1]
    vectors = docs.select(retrieval.concept_vector(F.col("text"), [["the", "of"], ["cat"]]).alias("v")).selectExpr("v[0]", "v[1]")
    assert times(vectors, "[\\p{L}\\p{N}]+") == 1
    assert [tuple(r) for r in vectors.collect()] == [(0.89442719, 0.4472136), (1.0, 0.0), (0.0, 0.0)]


def test_patches_of_many_small_rows_are_made_by_all_tasks(spark):
    from brightloom.operators import patches
    from brightloom.plans import files as file_queries

    assert file_queries.versions(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    odd = [0, False, 1, True, 1.0, -0.0, 0.0, None, "", "1", [], [1], {}, float("nan")]
    assert all(patches.same(a, b) == (patches.canonical(a) == patches.canonical(b)) for a in odd for b in odd)


def test_an_index_moves_no_lexemes_and_no_documents(spark, monkeypatch):
    monkeypatch.setattr(postings, "PARTS", 2)  # buckets of several blocks
    schema = "reference_id long, chunk_id string, source_kind string, task_id long, path string, title string, symbol string, start_line long, content string"
    refs = spark.createDataFrame([(i, f"c{i}", "CODE", None, f"src/a{i % 5}.py", "title", "x.read", 1, f"the w{i % 3} the and w{i % 7}") for i in range(200)], schema)
    index = postings.build_references(refs, block=20)
    forward = index.documents(spark)
    moved = lambda df: re.findall("Exchange (?:hash|range|Round).*", df._jdf.queryExecution().executedPlan().toString())
    made = postings.inverted(forward, 2, 5)
    assert [m.partition("(")[2].partition("#")[0] for m in moved(made)] == ["term"]
    rows = made.collect()
    assert len({r.block for r in rows}) == 10 and sorted(i for r in rows if r.term == "the" for i in r.ids) == list(range(200))
    asked = postings.normalised_queries(spark.createDataFrame([(1, "the and"), (2, "w1")], "query_id int, query string"))
    few = spark.createDataFrame([(1, 3), (2, 4)], "query_id int, id long").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len([m for m in moved(postings.scored(spark, index, few, asked)) if "hashpartitioning(id" in m]) == 1  # candidates come to the documents
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {(r.query_id, r.reference_id, r.score) for r in postings.search_references(spark, index, spark.createDataFrame([(1, "w1 and")], "query_id int, query string"), top_k=500).collect()}
    assert got == {(1, r.reference_id, r.score) for r in R.search(refs, "w1 and", top_k=None).collect()}
