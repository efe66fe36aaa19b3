import random

import pytest

from brightloom.operators import context, evidence

ITEM = "task_id long, kind string, order int, path string, symbol string, snippet string"
TASK = "task_id long, project_id string, heading string, wanted string, requested int"
NAME = "project_id string, path string, qualified_name string, line_start long"


def last(name):
    return name.rsplit(".", 1)[-1]


def mentions(text):
    return sorted({w.strip(".") for w in text.split() if "." in w.strip(".") and "/" not in w})


def paths_in(text):
    return sorted({w.strip(".") for w in text.split() if "/" in w})


def asked(text):
    said = {n for n, phrases in evidence.PHRASES.items() if any(p in text.lower() for p in phrases)}
    return max([0, *said, *[2] * bool(mentions(text)), *[1] * bool(paths_in(text))])


def plain(task, items, files, names):
    """One task's (start, level, steps, error) and files, step by step."""
    i, project, heading, wanted, requested = task
    text = f"{heading or ''} {wanted or ''}"
    by = lambda kind: sorted((x for x in items if x[0] == i and x[1] == kind), key=lambda x: x[2])
    own = {}
    for p, path, name, line in names:
        if p == project:
            own.setdefault(path, []).append((line, name))
    own = {p: [n for _, n in sorted(v)] for p, v in own.items()}
    start = asked(text)
    if start == 0 and any(h in text.lower() for h in evidence.IMPLEMENTATION):
        if any(x[4] for x in by("symbol") + by("result")) or by("test"):
            start = 2
        elif any(x[3] for x in by("file") + by("result")):
            start = 1
    start = level = max(start, requested or 0)
    steps, must = [], mentions(text)
    if level == 2 and must:
        shown = [(x[3], x[4]) for x in by("symbol")[:8]]
        donors = {x[3] for x in by("symbol")[:8] + by("file")[:5]}
        for path in sorted(p for p in own if p in donors):
            for m in must:
                same = [n for n in own[path] if last(n) == last(m)]
                match = m if m in same else same[-1] if same else None
                if match and (path, match) not in shown and len(shown) < 8:
                    shown.append((path, match))
        found = set()
        for path, symbol in shown:
            if symbol and path in own:
                fits = [n for n in own[path] if n == symbol] or [n for n in own[path] if n.endswith("." + last(symbol))]
                found |= {fits[0]} if fits else set()
        missing = [m for m in must if m not in found and last(m) not in {last(n) for n in found}]
        if missing:
            steps.append((2, 3, "required_signature_unresolved", " ".join(missing)[:160]))
            level = 3
    if level == 3 and must:
        blob = " ".join((x[5] or "")[:800] for x in by("result")[:5])
        every = {last(n) for v in own.values() for n in v}
        missing = [m for m in must if m not in blob and last(m) not in blob and last(m) in every]
        if missing:
            steps.append((3, 4, "implementation_excerpt_unavailable", " ".join(missing)[:160]))
            level = 4
    if level < 4:
        return start, level, steps, None, []
    tracked, named, shorts = {p for q, p in files if q == project}, paths_in(wanted or ""), {last(m) for m in mentions(wanted or "")}
    seen = list(dict.fromkeys(x[3] for x in by("file") + by("symbol") + by("result") if x[3] in tracked))
    defines = lambda p: any(last(n) in shorts for n in own.get(p, []))
    if named:
        error = evidence.FOREIGN if set(named) - tracked else None
        return start, level, steps, error, [] if error else named[:2]
    chosen = ([p for p in seen if defines(p)] or [p for p in sorted(own) if defines(p)]) if shorts else seen
    return start, level, steps, None if chosen else evidence.UNRESOLVED, chosen[:2]


def test_evidence_loop_is_the_plain_one(spark):
    rnd = random.Random(11)
    files = [(q, f"src/{m}.py") for q in "ab" for m in ("alpha", "beta", "gamma")]
    names = [(q, p, n, line) for q, p in files for line, n in enumerate(rnd.sample(["Svc", "Svc.run", "Svc.load", "load", "Box.run", "Box", "Box.keep", "keep"], rnd.randrange(0, 6)))]
    words = ["Inspect state", "implement it", "Svc.run", "Svc.load", "Box.keep", "Other.run", "Svc.nothing", "src/alpha.py", "src/delta.py", "symbol signatures", "implementation excerpt", "complete file", "entire repository", "module summary"]
    tasks, items = [], []
    for i in range(300):
        pick = lambda n: " ".join(rnd.choices(words, [3, 3, 3, 3, 3, 3, 3, 2, 0.7, 1, 1, 0.7, 0.3, 1], k=rnd.randrange(0, n)))
        tasks.append((i, rnd.choice("ab"), rnd.choice([None, pick(2)]), rnd.choice([None, pick(4), pick(4)]), rnd.choice([None] * 5 + [0, 2, 3, 5])))
        for kind in ("file", "symbol", "test", "result"):
            for order in range(rnd.choice([0, 0, 1, 3, 10]) if kind == "symbol" else rnd.choice([0, 1, 6])):
                path = rnd.choice(["src/alpha.py", "src/beta.py", "src/gamma.py", "src/gone.py", None])
                symbol = rnd.choice(["Svc.run", "run", "Box.keep", "x.load", None])
                items.append((i, kind, order, path, symbol, rnd.choice(["def run", "x" * 800 + " keep", "load keep", None])))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found, chosen = evidence.disclose(df(tasks, TASK), df(items, ITEM), df(files, "project_id string, path string"), df(names, NAME))
    got = {r.task_id: (r.start, r.level, [tuple(s) for s in r.steps], r.error) for r in found.collect()}
    shown = {}
    for r in chosen.orderBy("rank").collect():
        shown.setdefault(r.task_id, []).append(r.path)
    want = {t[0]: plain(t, items, files, names) for t in tasks}
    wrong = {i: (tasks[i], w[:4], got.get(i), [x for x in items if x[0] == i]) for i, w in want.items() if w[:4] != got.get(i)}
    assert not wrong, next(iter(wrong.items()))
    assert {i: w[4] for i, w in want.items() if w[4]} == shown
    assert {w[3] for w in want.values()} == {None, evidence.FOREIGN, evidence.UNRESOLVED} and {len(w[2]) for w in want.values()} == {0, 1, 2}
    none = evidence.disclose(df([], TASK), df([], ITEM), df(files, "project_id string, path string"), df(names, NAME))
    assert none[0].count() == none[1].count() == 0


@pytest.mark.parametrize(("text", "level"), [
    ("Inspect the current project checkpoint only.", 0), ("Need module summaries for the service.", 1), ("Include src/context.py provenance.", 1), ("Need symbol signatures for TargetContextService.build_context.", 2),
    ("Include the implementation excerpt for build_context.", 3), ("Return the complete file src/context.py.", 4), ("Perform a repository-wide investigation of all tracked files.", 5), ("Check api.openai.com availability.", 0),
    ("Inspect status.example.cloud and docs.vendor.tech.", 0), ("Contact foo.bar@example.com about the project.", 0), ("Inspect service.client.request.", 2), ("", 0),
])
def test_asked_levels(spark, text, level):
    from pyspark.sql import functions as F

    assert spark.range(1).select(evidence.asked_level(F.lit(text))).first()[0] == level


def test_required_results_and_budgets(spark):
    tasks = spark.createDataFrame([(1, "See SRC\\a.py and Run", 2), (2, "nothing", 3), (3, None, 3), (4, "x", 0), (5, "nothing", 3)], "task_id long, text string, level int")
    references = spark.createDataFrame([(1, "file", "src/a.py", None), (1, "symbol", None, "Svc.run"), (1, "test", "run", "run"), (2, "file", None, None)], "task_id long, kind string, path string, symbol string")
    results = spark.createDataFrame(
        [(1, 0, 10, "src/a.py", None, "a"), (1, 1, 11, None, "Svc.run", "b"), (1, 2, 12, "z", "Other.run", "c"), (1, 3, 12, "src/a.py", None, "d"), (2, 5, 1, None, None, "e"), (2, 6, 2, None, None, "f"), (3, 0, 1, None, None, None), (4, 0, 1, "w.py", None, "g" * 9000), (4, 1, 2, "v.py", None, "h" * 9000)],
        "task_id long, idx int, reference_id long, path string, symbol string, item string",
    )
    complete = spark.createDataFrame([(4, "w.py")], "task_id long, path string")
    must = context.required_results(tasks, references, results, complete)
    assert sorted(map(tuple, must.collect())) == [(1, 0), (1, 1), (1, 3), (2, 5), (3, 0), (4, 0)]
    fixed = spark.createDataFrame([(5, "task:contract", "t" * 40_000)], "task_id long, identity string, item string")
    governance = spark.createDataFrame([(4, 0, "CHECKPOINT", "k"), (4, 1, "CHECKPOINT", "k"), (4, 2, "SCOPE", "s"), (4, 3, "SCOPE", "s")], "task_id long, idx int, kind string, item string")
    excerpts = spark.createDataFrame([(4, "x" * 100)], "task_id long, item string")
    items = context.plan_items(fixed, excerpts, governance, results, must)
    rows = {(r.task_id, r.identity): r.required for r in items.collect()}
    assert rows == {(1, "retrieval:10"): True, (1, "retrieval:11"): True, (1, "retrieval:12"): True, (2, "retrieval:1"): True, (2, "retrieval:2"): False, (3, "retrieval:1"): True, (4, "retrieval:1"): True, (4, "retrieval:2"): False,
                    (4, "governance:0:CHECKPOINT"): True, (4, "governance:1:CHECKPOINT"): True, (4, "governance:2:SCOPE"): True, (4, "governance:3:SCOPE"): False, (4, "task:excerpt"): False, (5, "task:contract"): True}
    signals = spark.createDataFrame([(i, 0 if i == 4 else 5, {"result": 4}, ["retrieval_truncated"], i == 4) for i in range(1, 7)], "task_id long, level int, counts map<string,int>, flags array<string>, whole boolean")
    kept, summary = context.fitted(items, context.budget_signals(signals))
    s = {r.task_id: r for r in summary.collect()}
    assert (s[4].effective, s[4].removed, s[4].error) == (4096 + 256 + 128 + 256, ["retrieval:2"], None) and s[4].before - s[4].after == s[4].avoided > 2000
    assert s[4].reasons == ["retrieval_evidence_breadth", "l4_complete_file_required", "final_payload_serialization_allowance", "retrieval_truncated", "final_payload_serialization_headroom", "optional_context_reduced_to_fit"]
    assert (s[5].error, s[5].effective, s[5].removed) == (context.TOO_MUCH, None, None)
    assert (s[6].effective, s[6].before, s[6].after, s[6].removed) == (4096 + 1024 + 256 + 128 + 256, 0, 0, [])
    assert {(r.task_id, r.identity) for r in kept.collect() if not r.kept} == {(4, "retrieval:2"), (5, "task:contract")}
    left = context.following(results.select("task_id", "reference_id"), results, kept)
    assert (4, 2) not in set(map(tuple, left.collect())) and (4, 1) in set(map(tuple, left.collect()))
