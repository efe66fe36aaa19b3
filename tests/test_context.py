"""Payload faults, diffs, governing sections and capabilities against examples and a plain version."""

import json

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from brightloom.operators import governance as G
from brightloom.operators import payloads as P


@pytest.mark.parametrize(
    ("payload", "why"),
    [
        (None, "not_json"), ("", "not_json"), ("[]", "not_object"), ("{}", None), ('{"a": null, "b": true, "c": 1.5}', None), ('{"a": NaN}', "number"), ('{"a": ""}', "string"), ('{"": 1}', "key"),
        ('{"input_tokens": 1}', None), ('{"session-token": 1}', "secret_key"), ('{"a": "x%2520y", "b": "bearer abc"}', "secret_value"), ('{"a": "C:\\\\x"}', "path"), ('{"a": "file:/x"}', "path"), ('{"a": "and/or"}', None),
        ('{"a": "https://u:p@h/x"}', "secret_value"), ('{"a": "https://h/x"}', None), ('{"a": "/"}', "path"), (json.dumps({"a": "x" * 1025}), "string"), (json.dumps({"a": [0] * 101}), "items"), (json.dumps({"a": 2**53}), None),
        (json.dumps({str(i): ["y" * 1000] * 10 for i in range(10)}), "bytes"), ("[" * 100_000, "not_json"),
    ],
)
def test_payload_faults(payload, why):
    assert P.fault(payload) == why


def test_diffs(spark):
    rows = [(1, "a\nb\n", "a\nc\n"), (2, "same", "same"), (3, None, None), (4, "x\0", "y"), (5, "", "l\n" * 20_000), (6, "", "see /etc/passwd now")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: r.d for r in df.select("id", P.unified_diff(spark, df.id.cast("string"), df.a, df.b).alias("d")).collect()}
    assert got[1].text == "--- a/1+++ b/1@@ -1,2 +1,2 @@ a\n-b\n+c\n" and not got[1].binary
    assert got[2].text == got[3].text == ""
    assert got[4].binary and got[4].text == "[binary diff omitted]"
    assert got[5].truncated and len(got[5].text) == P.DIFF_CHARS + len("\n[diff truncated]")
    assert "/etc" not in got[6].text


def test_answers_and_languages(spark):
    df = spark.createDataFrame([("a", '{"x":1}', "Setup.py"), ("a", '{"x":"/etc/passwd"}', "app.TSX"), ("b", "y" * 65537, "Dockerfile.dev"), ("b", None, None), ("c", "", "notes")], "g string, j string, name string")
    assert [r[0] for r in df.select(P.bounded_answer(df.j)).collect()] == ['{"x":1}', None, None, None, ""]
    assert {r.g: list(r.languages) for r in P.language_stacks(df, "g").collect()} == {"a": ["python", "typescript"], "b": ["docker"], "c": []}


def plain(sections, kinds, budget, slots, most):
    """One task's excerpts as (kind, index, length), or why there are none."""
    first = sorted((s for s in sections if s[0] == kinds[0]), key=lambda s: s[1])
    ranked = [sorted((s for s in sections if s[0] == k), key=lambda s: (-s[3], s[1])) for k in kinds[1:]]
    if not first or not all(ranked):
        return "MISSING"
    if len(first) + len(ranked) > min(slots, budget):
        return "UNSATISFIABLE"
    out, left = [], budget
    own = budget - min(len(ranked) * most, budget - len(first))
    for i, s in enumerate(first):
        cut = min(s[2], most, own // (len(first) - i))
        out, own, left = [*out, (s[0], s[1], cut)], own - cut, left - cut
    for i, r in enumerate(ranked):
        cut = min(r[0][2], most, left // (len(ranked) - i))
        out, left = [*out, (r[0][0], r[0][1], cut)], left - cut
    for s in (s for r in ranked for s in r[1:] if s[3] > 0):
        if len(out) >= slots or left <= 0:
            break
        cut = min(s[2], most, left)
        out, left = [*out, (s[0], s[1], cut)], left - cut
    return out


sections = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 40), st.integers(0, 60), st.integers(0, 3)), max_size=14, unique_by=lambda s: s[:2])


@settings(max_examples=6, deadline=None, phases=[Phase.generate])
@given(st.lists(sections, min_size=1, max_size=30), st.integers(2, 120), st.integers(2, 8))
def test_governance(spark, tasks, budget, slots):
    rows = [(t, k, i, "é" * n, s) for t, ss in enumerate(tasks) for k, i, n, s in ss]
    df = spark.createDataFrame(rows, "task_id int, kind string, index int, text string, score int")
    got = {}
    for r in G.governance(df, ("a", "b", "c"), budget=budget, slots=slots, most=25).orderBy("task_id", "order").collect():
        if r.state == "COMPLETE":
            got.setdefault(r.task_id, []).append((r.kind, r["index"], len(r.excerpt)))
        else:
            got[r.task_id] = r.state
    assert got == {t: plain(ss, "abc", budget, slots, 25) for t, ss in enumerate(tasks) if ss}


def test_governance_edges(spark):
    df = spark.createDataFrame([(1, "a", 0, None, None), (1, "b", 1, "x", None), (2, "other", 0, "x", 1)], "task_id int, kind string, index int, text string, score int")
    rows = {(r.task_id, r.state, r.kind, r.excerpt) for r in G.governance(df, ("a", "b")).collect()}
    assert rows == {(1, "COMPLETE", "a", ""), (1, "COMPLETE", "b", "x"), (2, "MISSING", None, None)}
    assert G.governance(df.limit(0), ("a", "b")).count() == 0


def test_capabilities(spark):
    df = spark.createDataFrame([(1, True, False, True, None, "AVAILABLE", None, 0, 2, None, 1)], "project_id int, governance_ok boolean, decisions_ok boolean, memory_ok boolean, index_status string, retrieval_status string, dependency_status string, commits int, runs int, modules int, quality_points int")
    got = {r.id: (r.status, r.provenance) for r in G.capabilities(df).collect()}
    assert len(got) == 10 and got["decisions-memory"] == ("DEGRADED", "UNKNOWN") and got["latest-commits"] == ("UNAVAILABLE", "UNAVAILABLE") and got["index-health"] == ("UNKNOWN", "EXACT")
