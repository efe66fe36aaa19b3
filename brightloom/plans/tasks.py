"""Composite queries over many tasks: the evidence loop of disclosure, and the context plan.

A customer stands for a task, a part for a module of the project; what was found for a task, and what its context holds, is written from these rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import code, context, evidence
from .code import sources
from .registry import query, table

#: What a task wants, by c_custkey % 9; %d is its number.
_WANTED = (
    "Inspect the current project checkpoint only.", "Need module summaries for the service.", "Need symbol signatures for Part%d.size.", "Need symbol signatures for Part%d.missing_method.",
    "Include the implementation excerpt for Part%d.kind.", "Include the implementation excerpt for Part%d.size.", "Return the complete file src/mod_%d.py.", "Return the complete file other/none.py.", "Implement the order flow.",
)


def disclosure_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    i = F.col("c_custkey")
    number = i.cast("string")
    of = (i % 9).cast("int")
    tasks = table(spark, sf_dir, "customer").select(
        i.alias("task_id"), F.lit("p").alias("project_id"), F.col("c_name").alias("heading"), F.replace(F.element_at(F.array(*map(F.lit, _WANTED)), of + 1), F.lit("%d"), number).alias("wanted"),
        F.when(i % 27 == 1, 2).when(i % 27 == 10, 5).alias("requested"),
    )
    path, name = F.concat(F.lit("src/mod_"), number, F.lit(".py")), F.concat(F.lit("Part"), number)
    row = lambda kind, order, symbol, snippet: table(spark, sf_dir, "customer").select(i.alias("task_id"), F.lit(kind).alias("kind"), F.lit(order).alias("order"), path.alias("path"), symbol.alias("symbol"), snippet.alias("snippet"))
    none = F.lit(None).cast("string")
    items = row("file", 0, none, none).unionByName(row("symbol", 0, name, none)).unionByName(row("result", 0, name, F.when(i % 2 == 0, "async def kind(self)").otherwise("nothing")))
    items = items.where("NOT (task_id % 9 = 8 AND (kind <> 'file' OR task_id % 2 = 0))")
    s = sources(spark, sf_dir).withColumn("project_id", F.lit("p"))
    return tasks, items, s.select("project_id", "path"), code.outlines(s).withColumn("project_id", F.lit("p"))


_DISCLOSED = """t AS (SELECT c_custkey AS i, c_custkey % 9 AS k, CASE c_custkey % 27 WHEN 1 THEN 2 WHEN 10 THEN 5 ELSE 0 END AS requested, p_size <> 1 AS parsed, p_partkey IS NOT NULL AS there FROM customer LEFT JOIN part ON p_partkey = c_custkey),
    s AS (SELECT *, greatest(requested, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 4 WHEN 8 THEN i % 2 ELSE 0 END) AS start FROM t),
    e AS (SELECT *, start = 2 AND (k = 3 OR k = 2 AND NOT coalesce(parsed, false)) AS lacks2 FROM s),
    l AS (SELECT *, (start = 3 AND (k = 4 AND i % 2 = 1 OR k = 5)) OR lacks2 AND k = 2 AS lacks3 FROM e),
    f AS (SELECT *, start + CASE WHEN lacks2 THEN 1 ELSE 0 END + CASE WHEN lacks3 THEN 1 ELSE 0 END AS level FROM l)"""


@query(f"""WITH {_DISCLOSED} SELECT i AS task_id, CAST(start AS INT) AS start, CAST(level AS INT) AS level,
    concat_ws(' ', CASE WHEN lacks2 THEN '2>3:required_signature_unresolved:Part' || i || CASE WHEN k = 3 THEN '.missing_method' ELSE '.size' END END,
        CASE WHEN lacks3 THEN '3>4:implementation_excerpt_unavailable:Part' || i || CASE WHEN k = 4 THEN '.kind' ELSE '.size' END END) AS steps,
    CASE WHEN level >= 4 AND k = 7 THEN 'cross_project_disclosure_evidence' WHEN level >= 4 AND k = 6 AND NOT there THEN 'cross_project_disclosure_evidence' WHEN level >= 4 AND k = 1 AND NOT there THEN 'l4_target_unresolved' END AS error FROM f""")  # fmt: skip
def disclosure_evidence(spark, sf_dir):
    found, _ = evidence.disclose(*disclosure_inputs(spark, sf_dir))
    said = F.transform("steps", lambda s: F.concat(s["from"].cast("string"), F.lit(">"), s["to"].cast("string"), F.lit(":"), s["reason"], F.lit(":"), s["evidence"]))
    return found.withColumn("steps", F.array_join(said, " "))


@query(f"""WITH {_DISCLOSED}, m AS (SELECT 'src/mod_' || p_partkey || '.py' AS path, row_number() OVER (ORDER BY 'src/mod_' || p_partkey || '.py') AS r FROM part WHERE p_size <> 1)
    SELECT i AS task_id, 1::BIGINT AS rank, 'src/mod_' || i || '.py' AS path FROM f WHERE level >= 4 AND (k IN (1, 6) AND there OR k IN (2, 4, 5) AND coalesce(parsed, false))
    UNION ALL SELECT i, r, path FROM f, m WHERE level >= 4 AND k IN (2, 4, 5) AND NOT coalesce(parsed, false) AND r <= 2""")  # fmt: skip
def disclosure_complete_files(spark, sf_dir):
    return evidence.disclose(*disclosure_inputs(spark, sf_dir))[1]


def plan_inputs(spark, sf_dir):
    """A conversation is a task: its first turn is its text, user turns are results, assistant turns governance, others references."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), "turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("conv_id") % 6).cast("int").alias("level"))
    path, symbol = F.concat(F.lit("d/"), (F.col("turn") % 3).cast("string"), F.lit(".md")), F.concat(F.lit("T."), F.element_at(F.array(F.lit("the"), F.lit("und"), F.lit("que"), F.lit("zzz")), (F.col("turn") % 4 + 1).cast("int")))
    tasks = c.where("turn = 0").select("task_id", "text", "level")
    item = F.repeat("text", F.lit(12))
    results = c.where("turn % 3 > 0").select("task_id", F.col("turn").alias("idx"), (F.col("turn") % 7).alias("reference_id"), F.when(F.col("turn") % 2 == 0, path).alias("path"), F.when(F.col("turn") % 5 > 0, symbol).alias("symbol"), item.alias("item"))
    references = c.where("turn > 0").select("task_id", (F.col("turn") % 7).alias("reference_id"), F.when(F.col("turn") % 2 == 0, "file").otherwise("symbol").alias("kind"), path.alias("path"), symbol.alias("symbol"))
    governance = c.where("turn % 3 = 0").select("task_id", F.col("turn").alias("idx"), F.when(F.col("turn") % 2 == 0, "CHECKPOINT").otherwise("SCOPE").alias("kind"), item.alias("item"))
    complete = tasks.where("level >= 4").select("task_id", F.lit("d/1.md").alias("path"))
    fixed = tasks.select("task_id", F.lit("task:contract").alias("identity"), F.repeat("text", (F.col("task_id") % 4 * 40 + 1).cast("int")).alias("item"))
    flags = F.array_compact(F.array(F.when(F.col("task_id") % 2 == 0, "task_excerpt_truncated"), F.when(F.col("task_id") % 3 == 0, "disclosure_truncated")))
    n = c.groupBy("task_id").agg(F.count_if(F.col("turn") % 3 > 0).alias("r"), F.count_if((F.col("turn") > 0) & (F.col("turn") % 2 == 0)).alias("f"))
    signals = tasks.join(n, "task_id").select("task_id", "level", F.create_map(F.lit("result"), F.col("r"), F.lit("file"), F.col("f")).alias("counts"), flags.alias("flags"), (F.col("level") >= 4).alias("whole"))
    return tasks, references, results, governance, complete, fixed, signals


def planned(spark, sf_dir):
    tasks, references, results, governance, complete, fixed, signals = plan_inputs(spark, sf_dir)
    must = context.required_results(tasks, references, results, complete)
    items = context.plan_items(fixed, tasks.select("task_id", F.col("text").alias("item")), governance, results, must)
    return (references, results, *context.fitted(items, context.budget_signals(signals)))


_PLAN = """c AS (SELECT conv_id AS task_id, turn, coalesce(text, '') AS text, CAST(conv_id % 6 AS INT) AS level, 'd/' || (turn % 3) || '.md' AS path, ['the', 'und', 'que', 'zzz'][turn % 4 + 1] AS last FROM conversations),
    t AS (SELECT task_id, lower(text) AS text, level, text AS raw FROM c WHERE turn = 0), refs AS (SELECT task_id, turn % 7 AS reference_id, CASE WHEN turn % 2 = 0 THEN 'file' ELSE 'symbol' END AS kind, path, last FROM c WHERE turn > 0),
    res AS (SELECT task_id, turn AS idx, turn % 7 AS reference_id, CASE WHEN turn % 2 = 0 THEN path END AS path, CASE WHEN turn % 5 > 0 THEN last END AS last, repeat(text, 12) AS item FROM c WHERE turn % 3 > 0),
    p AS (SELECT DISTINCT task_id, path FROM refs JOIN t USING (task_id) WHERE contains(t.text, path) UNION SELECT task_id, 'd/1.md' FROM t WHERE level >= 4),
    s AS (SELECT DISTINCT task_id, last FROM refs JOIN t USING (task_id) WHERE kind = 'symbol' AND contains(t.text, last)),
    m1 AS (SELECT task_id, idx FROM res SEMI JOIN p USING (task_id, path) UNION SELECT task_id, idx FROM res SEMI JOIN s USING (task_id, last)),
    m AS (SELECT * FROM m1 UNION SELECT task_id, min(idx) FROM res WHERE task_id IN (SELECT task_id FROM t WHERE level = 3) AND task_id NOT IN (SELECT task_id FROM m1) GROUP BY task_id),
    r AS (SELECT task_id, reference_id, idx, item, m.idx IS NOT NULL AS must FROM res LEFT JOIN m USING (task_id, idx) QUALIFY row_number() OVER (PARTITION BY task_id, reference_id ORDER BY m.idx IS NULL, idx) = 1),
    i AS (SELECT task_id, 'task:contract' AS identity, true AS required, 0 AS a, 0 AS b, repeat(raw, CAST(task_id % 4 * 40 + 1 AS BIGINT)) AS item FROM t UNION ALL SELECT task_id, 'task:excerpt', false, 1, 0, raw FROM t
        UNION ALL SELECT task_id, 'retrieval:' || reference_id, must, 3, idx, item FROM r
        UNION ALL SELECT task_id, 'governance:' || turn || ':' || CASE WHEN turn % 2 = 0 THEN 'CHECKPOINT' ELSE 'SCOPE' END, turn % 2 = 0 OR row_number() OVER (PARTITION BY task_id, turn % 2 ORDER BY turn) = 1, 2, turn, repeat(text, 12) FROM c WHERE turn % 3 = 0),
    g AS (SELECT task_id, count(*) FILTER (WHERE turn % 3 > 0) AS nr, count(*) FILTER (WHERE turn > 0 AND turn % 2 = 0) AS nf FROM c GROUP BY 1),
    b AS (SELECT t.task_id, 4096 + [0, 128, 256, 512, 1024, 1024][level + 1] + 256 + CASE WHEN nf > 1 THEN 128 ELSE 0 END + CASE WHEN nr > 3 THEN 128 ELSE 0 END + CASE WHEN t.task_id % 2 = 0 THEN 256 ELSE 0 END + CASE WHEN t.task_id % 3 = 0 THEN 256 ELSE 0 END AS signalled FROM t JOIN g USING (task_id)),
    w AS (SELECT *, strlen(item) AS n, (coalesce(sum(strlen(item) + 1) FILTER (WHERE required) OVER (PARTITION BY task_id), 0) - 1 + 3) // 4 + 64 AS need,
        (sum(strlen(item) + 1) OVER (PARTITION BY task_id ORDER BY required DESC, a, b, identity) - 1 + 3) // 4 + 64 AS used FROM i JOIN b USING (task_id)),
    k AS (SELECT *, least(greatest(signalled, need), 6144) AS effective, need > 6144 AS too_much FROM w),
    plan AS (SELECT *, NOT too_much AND (required OR used <= greatest(2048, effective - 1024)) AS kept FROM k)"""


@query(f"WITH {_PLAN} SELECT task_id, identity, required, kept FROM plan")
def context_plan(spark, sf_dir):
    return planned(spark, sf_dir)[2]


@query(f"""WITH {_PLAN}, z AS (SELECT task_id, any_value(effective) AS effective, any_value(too_much) AS too_much, (sum(n + 1) - 1 + 3) // 4 + 64 AS before, (sum(n + 1) FILTER (WHERE kept) - 1 + 3) // 4 + 64 AS after,
        coalesce(array_to_string(list(identity ORDER BY a DESC, b DESC, identity DESC) FILTER (WHERE NOT required AND NOT kept), ' '), '') AS removed FROM plan GROUP BY task_id)
    SELECT task_id, CASE WHEN NOT too_much THEN CAST(effective AS BIGINT) END AS effective, CAST(before AS BIGINT) AS before, CASE WHEN NOT too_much THEN CAST(after AS BIGINT) END AS after, CASE WHEN NOT too_much THEN CAST(greatest(before - after, 0) AS BIGINT) END AS avoided,
        CASE WHEN NOT too_much THEN removed END AS removed, CASE WHEN too_much THEN 'required_context_exceeds_token_budget' END AS error FROM z""")  # fmt: skip
def context_budget(spark, sf_dir):
    return planned(spark, sf_dir)[3].drop("reasons").withColumn("removed", F.array_join("removed", " "))


@query(f"WITH {_PLAN} SELECT task_id, reference_id, kind, path, 'T.' || last AS symbol FROM refs WHERE (task_id, reference_id) IN (SELECT task_id, CAST(split_part(identity, ':', 2) AS BIGINT) FROM plan WHERE kept AND starts_with(identity, 'retrieval:'))")
def context_references(spark, sf_dir):
    references, results, items, _ = planned(spark, sf_dir)
    return context.following(references, results, items)
