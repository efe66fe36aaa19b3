import json

import pytest
from brightloom.operators import charts, code, disclosure, documents, patches
from brightloom.sources import files, git
from brightloom.streaming import events as stream
from pyspark.sql import functions as F


def test_patch_round_trip_and_refusals(spark):
    pairs = [('{"a":1,"b":{"c":[1,2]}}', '{"b":{"c":[1,3],"d":null}}'), ('{"a":true}', '{"a":1}'), ("{}", "{}"), ("[]", "{}"), (None, "{}")]
    df = spark.createDataFrame(pairs, "o string, n string").withColumn("p", patches.patch_between(spark, F.col("o"), F.col("n")))
    got = df.select("n", "p.*", patches.patched(spark, F.col("o"), F.col("p.value")).alias("r")).collect()
    assert json.loads(got[0]["value"]) == [{"op": "remove", "path": "/a"}, {"op": "add", "path": "/b/d", "value": None}, {"op": "replace", "path": "/b/c", "value": [1, 3]}]
    assert all(json.loads(r["r"]["value"]) == json.loads(r["n"]) for r in got[:3]) and got[1]["value"] != "[]" and got[2]["value"] == "[]"
    assert [r["error"] for r in got[3:]] == ["delta_semantic_payload_invalid"] * 2
    for patch, error in [
        ([{"op": "add", "path": "/a", "value": 1}], "delta_add_path_exists"), ([{"op": "remove", "path": "/z"}], "delta_remove_path_missing"), ([{"op": "replace", "path": "/z", "value": 1}], "delta_replace_path_missing"),
        ([{"op": "add", "path": "/x/y", "value": 1}], "delta_path_missing"), ([{"op": "add", "path": "/l/0", "value": 1}], "delta_array_item_operation_unsupported"), ([{"op": "add", "path": "/a/x", "value": 1}], "delta_parent_not_object"), ([{"op": "add", "path": "/~2", "value": 1}], "delta_pointer_escape_invalid"),
        ([{"op": "add", "path": "a", "value": 1}], "delta_path_malformed"), ([{"op": "replace", "path": "", "value": 1}], "delta_root_replace_requires_object"), ([{"op": "remove", "path": "/a" * 17}], "delta_path_depth_exceeded"),
    ]:
        with pytest.raises(ValueError, match=error):
            patches.apply({"a": 1, "l": [1]}, patch)


def test_store_refuses_changed_contents(spark):
    df = spark.createDataFrame([("a" * 1000,), ("a" * 1000,), ("",), (None,)], "content string")
    store = files.put(df)
    assert {(r.logical_size, r.physical_size < 100) for r in store.collect()} == {(1000, True), (0, True)}
    moved = files.transition(store, "COLD")
    assert {bytes(r.content) for r in files.read_verified(moved).collect()} == {b"a" * 1000, b""}
    with pytest.raises(Exception, match="does not match"):
        files.read_verified(moved.withColumn("sha256", F.sha2("sha256", 256))).collect()
    with pytest.raises(Exception, match="does not match"):
        files.read_verified(moved.withColumn("blob", F.lit(b"no zstd"))).collect()


def test_contents_are_verified_whatever_is_asked_of_them(spark, monkeypatch):
    from brightloom import plans

    store = files.put(spark.createDataFrame([("a" * 1000,), ("b",)], "content string"))
    bad = files.read_verified(store.withColumn("blob", F.lit(b"no zstd")))
    for df in (bad.select("sha256"), bad.groupBy().count()):
        with pytest.raises(Exception, match="does not match"):
            df.collect()
    assert sorted(r.sha256 for r in files.read_verified(store).select("sha256").collect()) == sorted(r.sha256 for r in store.collect())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(files.read_verified(store)).count("unpack(") == plan(bad.select("sha256")).count("unpack(") == 1  # and unpacked once
    query = plans.QUERIES["content_store"]
    assert "unpack(" in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    real = files.transition
    monkeypatch.setattr(files, "transition", lambda *a: real(*a).withColumn("blob", F.lit(b"no zstd")))
    with pytest.raises(Exception, match="does not match"):
        query(spark, "/root/testdata/sf0.001").collect()


def test_files_read_from_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# x\r\ny\r")
    (tmp_path / "sub" / "b.txt").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.decoded(files.files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": ("# x\ny\n", None), "b.txt": (None, "PDF_BY_ANOTHER_NAME"), "c.pdf": (None, "PDF_NEEDS_READER")}


@pytest.mark.parametrize("bad", ["100644 abc 0\tx", f"100644 {'a' * 40} 1\tx", f"100644 {'a' * 40} 0\tx\x00100644 {'a' * 40} 0\tx", f"100644 {'a' * 40} 0\t"])
def test_bad_index_is_an_error(spark, bad):
    with pytest.raises(Exception, match="index has"):
        git.index_entries(spark.createDataFrame([(1, bad)], "project_id long, content string")).collect()


def test_python_definitions():
    tree = code.parse("if True:\n    def a():\n        class B: pass\nclass C(D, E[int]):\n    x = 1\n    async def m(self, *, k=2): ...\n")
    assert [r[1] for r in code.symbol_rows(tree)] == ["a", "a.B", "C", "C.m"]
    assert [(r[0], r[2]) for r in code.outline_rows(tree)] == [("C", "class C(D, E[int])"), ("C.m", "async def m(self, *, k=2)")]
    assert code.parse("def :") is None and code.parse("\0") is None


def test_sections_and_odd_texts(spark):
    df = spark.createDataFrame([(1, "x\n# A \nb\n####### no\n## B\n"), (2, None), (3, ""), (4, "no heading")], "doc_id long, text string")
    got = [(r.heading, r.level, r.start_line, r.end_line, r.start_char, r.end_char) for r in documents.sections(df).orderBy("ordinal").collect()]
    assert got == [("A", 1, 2, 4, 2, 20), ("B", 2, 5, 5, 20, 25)]
    assert documents.sections(df.limit(0)).count() == 0 and documents.completion(df).count() == 0 and documents.status_documents(df).count() == 0


def test_running_rate_is_that_of_all_events(spark):
    rows = [(1, i, "cache.hit" if i % 3 else "cache.miss", "{}") for i in range(1, 60)] + [(2, 100, "x", "no json")]
    e = spark.createDataFrame(rows, "project_id long, ordering_id long, event_type string, payload string")
    none = spark.createDataFrame([], "project_id long, logical double, physical double")
    got = {r.ordering_id: r.value for r in charts.chart_points(e, none, 5).where("chart = 'cache-hit-rate'").collect()}
    assert got == {n: sum(1 for i in range(1, n + 1) if i % 3) / n for n in range(55, 60)}


def test_levels(spark):
    df = spark.createDataFrame([(0,), (3,), (5,)], "s int")
    no, yes = F.lit(False), F.lit(True)
    assert [r[0] for r in df.select(disclosure.final_level(F.col("s"), [no, yes, no, no, yes, no])).collect()] == [1, 4, 5]
    assert df.select(disclosure.bound(F.lit("other"), F.col("s"))).first()[0] == 0


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    write = lambda ids: spark.createDataFrame([(i, str(i)) for i in ids], "event_id long, x string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(range(1, 6))
    assert stream.replay(spark, str(tmp_path / "in"), str(tmp_path / "out"), 2).count() == 3
    write([4, 5, 6, 6, 7])
    got = stream.replay(spark, str(tmp_path / "in"), str(tmp_path / "out"), 2)
    assert sorted(r.event_id for r in got.collect()) == [3, 4, 5, 6, 7]


def test_cursors(spark):
    df = spark.createDataFrame([("12",), ("0",), ("01",), ("-1",), ("1a",), ("",), (None,), ("9" * 19,)], "c string")
    assert [r[0] for r in df.select(stream.valid_cursor(F.col("c"))).collect()] == [12] + [None] * 7


def test_contents_go_through_python_few_at_a_time(spark):
    from brightloom import plans

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = plans.QUERIES["content_store"](spark, "/root/testdata/sf0.001")
    assert int(got.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert got._jdf.queryExecution().optimizedPlan().toString().count("pack(") <= 1  # each tier is written, not made again by every reader
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before and got.count() > 0
