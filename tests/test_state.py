import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from brightloom.streaming import state


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def added(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/f={n}")


def test_values_expire_also_after_a_restart(spark, tmp_path):
    ops, into = str(tmp_path / "ops"), str(tmp_path / "into")
    added(spark, [(1, "put", "a", "v1", at(0)), (2, "get", "a", None, at(10)), (3, "get", "b", None, at(10)), (4, "get", "a", None, at(279)), (5, "get", "a", None, at(280)), (6, "get", None, None, at(1)), (7, "put", "a", "v2", at(280)), (8, "get", "a", None, None)], state.OPS, ops, 0)
    first = {r.request_id: r.value for r in state.expiring(spark, f"{ops}/*", into).collect()}
    assert first == {2: "v1", 3: None, 4: "v1", 5: "v2", 6: None}
    added(spark, [(9, "get", "a", None, at(579)), (10, "get", "a", None, at(580)), (11, "put", "b", "w", at(581)), (12, "get", "b", None, at(880)), (13, "get", "b", None, at(881))], state.OPS, ops, 1)
    later = {r.request_id: r.value for r in state.expiring(spark, f"{ops}/*", into).collect()}
    assert later == first | {9: "v2", 10: None, 12: "w", 13: None}
    added(spark, [(14, "get", "a", None, at(90_000))], state.OPS, ops, 2)
    assert {r.request_id: r.value for r in state.expiring(spark, f"{ops}/*", into).collect()} == later | {14: None}


def test_baselines_resolve_for_their_own_project_and_task_only(spark, tmp_path):
    a, b, c, head = "a" * 64, "b" * 64, "c" * 64, "d" * 40
    pointer = lambda p, t, i, o: json.dumps({"schema_version": state.POINTER_VERSION, "project_id": p, "task_id": t, "context_input_fingerprint": i, "context_output_fingerprint": o, "repository_head_sha": head})
    held = lambda p, t, i, o: json.dumps({"schema_version": state.CACHE_VERSION, "project_id": p, "task_id": t, "context_input_fingerprint": i, "context_output_fingerprint": o, "serialized_capsule": "{}"})
    puts = {
        "baseline:1:1:" + b: pointer("1", "1", a, b), "context:1:" + a: held("1", "1", a, b), "baseline:1:2:" + b: pointer("1", "1", a, b), "baseline:1:3:" + b: '{"schema_version":"delta-baseline-v1","project_id":"bad"}', "baseline:1:4:" + c: pointer("1", "4", c, c),
        "context:1:" + c: held("1", "9", c, c), "baseline:1:5:" + b: pointer("1", "5", "not hex", b), "baseline:1:6:" + b: pointer("1", "6", a, b) + " " * 9000, "baseline:1:7:" + b: pointer("1", "7", b, b),
    }
    added(spark, [(None, "put", k, v, at(0)) for k, v in puts.items()], state.OPS, str(tmp_path / "ops"), 0)
    asked = [(1, 1, 1, b, at(1)), (2, 1, 2, b, at(1)), (3, 1, 3, b, at(1)), (4, 1, 4, c, at(1)), (5, 1, 5, b, at(1)), (6, 1, 6, b, at(1)), (7, 1, 7, b, at(1)), (8, 2, 1, b, at(1)), (9, 1, 1, c, at(1)), (10, 1, 1, b, at(300)), (11, 1, 1, b, at(299))]
    requests = spark.createDataFrame(asked, "request_id long, project_id long, task_id long, output string, at timestamp")
    got = {r.request_id: (r.state, r.capsule) for r in state.resolved_baselines(spark, str(tmp_path / "ops/*"), requests).collect()}
    no = ("NO_POINTER", None)
    assert got == {1: ("RESOLVED", "{}"), 2: no, 3: no, 4: ("NO_CONTEXT", None), 5: no, 6: no, 7: ("NO_CONTEXT", None), 8: no, 9: no, 10: no, 11: ("RESOLVED", "{}")}
    made = spark.range(1).select(state.pointer(F.lit(1), F.lit(2), F.lit(a), F.lit(b), F.lit(head.upper())).alias("p"))
    assert made.select(state.valid_pointer(F.col("p"), F.lit(1), F.lit(2), F.lit(b))).first()[0] == a


@pytest.mark.parametrize("files", [1, 6])
def test_client_buffers_do_not_depend_on_batches(spark, tmp_path, files):
    rnd = random.Random(9)
    rows = [(rnd.choice(["x", "y", "z"]), f"e{i:03}", i // 2, rnd.choice([None, "p"])) for i in range(120)]
    rnd.shuffle(rows)
    rows += [max(rows, key=lambda r: r[2:0:-1])] + [("w", "only", 1, None), (None, "e", 1, None), ("x", None, 1, None), ("x", "e", None, None)]
    path, into = str(tmp_path / "events"), str(tmp_path / "into")
    for n in range(files):
        added(spark, rows[n::files], state.EVENTS, path, n)
        if n == 2:
            state.client_buffers(spark, f"{path}/*", into, n=5, files_per_batch=1)
    got = {r.client: (r.dropped, json.loads(r.events)) for r in state.client_buffers(spark, f"{path}/*", into, n=5, files_per_batch=1).collect()}
    for client in "wxyz":
        own = sorted({(o, i, e) for c, i, o, e in rows if c == client and i and o is not None})
        assert got[client] == (max(0, len(own) - 5), [list(x) for x in own[-5:]])
    assert set(got) == set("wxyz")


@pytest.mark.parametrize("large", [1 << 20, 7, 1])
def test_running_shares_of_large_and_small_runs(spark, large):
    from brightloom.operators import events

    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i * 3, rnd.random() < 0.3, rnd.random() < 0.3) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id long, ordering_id long, g boolean, b boolean").repartition(3)
    got = sorted((r.run_id or 0, r.ordering_id, r.good, r.bad) for r in events.running(df, F.col("g"), F.col("b"), large=large).collect())
    want, sums = [], {}
    for run, i, g, b in rows:
        s = sums[run] = (sums.get(run, (0, 0))[0] + g, sums.get(run, (0, 0))[1] + b)
        if sum(s):
            want.append((run or 0, i, *s))
    assert got == sorted(want)


def test_state_is_folded_by_spark_and_not_key_by_key_in_python(spark, tmp_path):
    """A key with state used to cost some calls of Python, 2.5 ms in all."""
    ops, events = str(tmp_path / "ops"), str(tmp_path / "events")
    spark.range(20_000).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, "put").otherwise("get").alias("op"), F.expr("'k' || id DIV 2").alias("key"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("value"),
        F.timestamp_seconds(F.col("id") + 1).alias("at"),
    ).coalesce(1).write.parquet(ops)
    answers, values = state.answered(spark.read.schema(state.OPS).parquet(ops), spark.createDataFrame([], state.VALUES), 300)
    assert "InPandas" not in answers._jdf.queryExecution().toString() + values._jdf.queryExecution().toString()
    found = state.expiring(spark, ops)
    assert found.count() == 10_000 and found.where("value <=> CAST(request_id - 1 AS STRING)").count() == 10_000
    added(spark, [("x", f"e{i}", i, "p") for i in range(9)], state.EVENTS, events, 0)
    got = state.client_buffers(spark, f"{events}/*", n=2)
    assert [tuple(r) for r in got.collect()] == [("x", 9, 7, '[[7,"e7","p"],[8,"e8","p"]]')]


def test_a_value_that_comes_in_a_later_batch_but_was_put_earlier_is_not_the_newest(spark, tmp_path):
    ops, into = str(tmp_path / "ops"), str(tmp_path / "into")
    added(spark, [(1, "put", "a", "new", at(100))], state.OPS, ops, 0)
    state.expiring(spark, f"{ops}/*", into)
    added(spark, [(2, "put", "a", "old", at(50)), (3, "get", "a", None, at(60)), (4, "get", "a", None, at(101)), (5, "get", "a", None, at(-500))], state.OPS, ops, 1)
    assert {r.request_id: r.value for r in state.expiring(spark, f"{ops}/*", into).collect()} == {3: "old", 4: "new"}


def test_a_baseline_is_asked_for_by_each_order(spark):
    from brightloom import plans

    got = plans.QUERIES["delta_baselines"](spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert sorted(r.request_id for r in got.collect()) == sorted(r.o_orderkey for r in orders.collect())
