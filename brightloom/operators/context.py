"""The context plan of many tasks: what must be in a task's context, what fits its token budget besides, and what follows from what is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import short

#: The budget without any signal, its bounds, what planning and the final form take, and what each signal adds.
BASE, LEAST, MOST, OVERHEAD, HEADROOM, FINAL_FORM = 4096, 2048, 6144, 64, 1024, 256
BY_LEVEL, BREADTH, TRUNCATED = (0, 128, 256, 512, 1024, 1024), 128, 256
#: More of these than so many widen a budget.
BREADTHS = {"file": ("resolved_file_breadth", 1), "symbol": ("resolved_symbol_breadth", 2), "test": ("resolved_test_breadth", 1), "result": ("retrieval_evidence_breadth", 3), "constraint": ("explicit_constraint_breadth", 2), "criterion": ("acceptance_criteria_breadth", 2)}
TRUNCATIONS = ("task_excerpt_truncated", "governance_truncated", "retrieval_truncated", "disclosure_truncated")
TOO_MUCH = "required_context_exceeds_token_budget"


def required_results(tasks: DataFrame, references: DataFrame, results: DataFrame, complete: DataFrame) -> DataFrame:
    """(task_id, idx): the results that must stay, by what the task mentions.

    A result stays if its path is shown whole, or is a found file's or symbol's path that the task's text has; or if its symbol, or the last part of it, is a
    found symbol that the text has whole or by its last part, in either case. At level 3 the first result stays if no other must. tasks: task_id, text, level.
    references: task_id, kind, path, symbol. results: task_id, idx, path, symbol. complete: task_id, path. Nulls mention nothing.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    flat = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    found = references.where("kind IN ('file', 'symbol')").join(tasks.select("task_id", text.alias("_t")), "task_id")
    paths = found.where((F.col("path") != "") & F.contains(flat(F.col("_t")), flat(F.lower("path")))).select("task_id", "path").unionByName(complete.select("task_id", "path")).distinct()
    low = F.lower("symbol")
    symbols = found.where("kind = 'symbol' AND symbol <> ''").where(F.contains("_t", low) | F.contains("_t", short(low))).select("task_id", "symbol").distinct()
    by_path = results.where("path <> ''").join(paths, ["task_id", "path"], "left_semi").select("task_id", "idx")
    each = results.where("symbol <> ''").select("task_id", "idx", F.explode(F.array_distinct(F.array(F.col("symbol"), short(F.col("symbol"))))).alias("symbol"))
    must = by_path.unionByName(each.join(symbols, ["task_id", "symbol"], "left_semi").select("task_id", "idx")).distinct()
    bare = tasks.where("level = 3").select("task_id").join(must, "task_id", "left_anti")
    first = results.join(bare, "task_id", "left_semi").groupBy("task_id").agg(F.min("idx").alias("idx"))
    return must.unionByName(first)


def required_governance(governance: DataFrame) -> DataFrame:
    """governance (task_id, idx, kind, item) with `required`: checkpoints, and the first excerpt of each kind."""
    n = F.row_number().over(Window.partitionBy("task_id", "kind").orderBy("idx"))
    return governance.withColumn("required", (F.col("kind") == "CHECKPOINT") | (n == 1))


def plan_items(fixed: DataFrame, excerpts: DataFrame, governance: DataFrame, results: DataFrame, must: DataFrame) -> DataFrame:
    """(task_id, identity, required, place, item): what a task's context may hold, in the order in which optional items are kept.

    fixed: task_id, identity, item, all required. excerpts: task_id, item. results: task_id, idx, reference_id, item; of results with one reference the first
    that must stay counts, else the first. No identity is both required and optional.
    """
    place = lambda n, idx: F.struct(F.lit(n).alias("kind"), idx.cast("long").alias("idx"))
    f = fixed.select("task_id", "identity", F.lit(True).alias("required"), place(0, F.lit(0)).alias("place"), "item")
    x = excerpts.select("task_id", F.lit("task:excerpt").alias("identity"), F.lit(False).alias("required"), place(1, F.lit(0)).alias("place"), "item")
    g = required_governance(governance)
    g = g.select("task_id", F.concat_ws(":", F.lit("governance"), "idx", "kind").alias("identity"), "required", place(2, F.col("idx")).alias("place"), "item")
    r = results.join(must.withColumn("required", F.lit(True)), ["task_id", "idx"], "left").withColumn("required", F.coalesce("required", F.lit(False)))
    r = r.groupBy("task_id", "reference_id").agg(F.min_by(F.struct("idx", "item", "required"), F.struct(~F.col("required"), "idx")).alias("r"))
    r = r.select("task_id", F.concat_ws(":", F.lit("retrieval"), "reference_id").alias("identity"), "r.required", place(3, F.col("r.idx")).alias("place"), "r.item")
    return reduce(DataFrame.unionByName, (x, g, r), f)


def budget_signals(tasks: DataFrame) -> DataFrame:
    """tasks (task_id, level, counts: map of numbers by kind, flags: array of truncations) with the budget that their signals give and the reasons."""
    more = {name: F.coalesce(F.col("counts")[kind], F.lit(0)) > most for kind, (name, most) in BREADTHS.items()}
    cut = {name: F.array_contains("flags", name) for name in TRUNCATIONS}
    by_level = F.element_at(F.array(*map(F.lit, BY_LEVEL)), F.col("level") + 1)
    added = by_level + FINAL_FORM + sum((F.when(c, BREADTH).otherwise(0) for c in more.values()), F.lit(0)) + sum((F.when(c, TRUNCATED).otherwise(0) for c in cut.values()), F.lit(0))
    level = [F.when(by_level > 0, F.concat(F.lit("progressive_disclosure_l"), F.col("level").cast("string")))]
    whole = [F.when(F.col("whole"), "l4_complete_file_required"), F.when(F.col("level") == 5, "l5_repository_investigation"), F.lit("final_payload_serialization_allowance")]
    names = lambda conds: [F.when(c, n) for n, c in conds.items()]
    reasons = F.array_compact(F.array(*level, *names(more), *whole, *names(cut)))
    return tasks.select("task_id", F.greatest(F.lit(LEAST), F.lit(BASE) + added).cast("long").alias("signalled"), reasons.alias("reasons"))


def estimate(n_bytes: Column, n: Column) -> Column:
    """Tokens of items joined by line ends: a token for four bytes, rounded up, and what planning takes; 0 without an item."""
    return F.when(n > 0, F.ceil((n_bytes + n - 1) / 4) + OVERHEAD).otherwise(0).cast("long")


def fitted(items: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((task_id, identity, required, kept), (task_id, effective, before, after, avoided, reasons, removed, error)): items within each task's budget.

    Required items always stay; if they alone need more than the signals give, the budget grows with them, up to its bound, beyond which the task keeps nothing
    and says so. A null item is empty. Optional items are dropped from the last on until the rest leaves headroom for the final form, so the longest beginning that fits stays.
    Sums run over a task's items; tasks are dealt by id. Tasks without items have a row as well.
    """
    own = Window.partitionBy("task_id")
    n = items.select("task_id", "identity", "required", "place", F.coalesce(F.octet_length("item"), F.lit(0)).cast("long").alias("_b")).join(signals, "task_id")
    when = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    must = F.col("required")
    n = n.withColumn("_rb", when(must, F.col("_b")).over(own)).withColumn("_rn", when(must, F.lit(1)).over(own))
    upto = own.orderBy(F.desc("required"), "place", "identity").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("_ub", F.sum("_b").over(upto)).withColumn("_un", F.count(F.lit(1)).over(upto))
    need = estimate(F.col("_rb"), F.col("_rn"))
    effective = F.least(F.greatest(F.col("signalled"), need), F.lit(MOST))
    over = need > MOST
    n = n.withColumn("_need", need).withColumn("_effective", effective).withColumn("_over", over)
    room = F.greatest(F.lit(LEAST), F.col("_effective") - HEADROOM)
    n = n.withColumn("kept", ~F.col("_over") & (must | (estimate(F.col("_ub"), F.col("_un")) <= room)))
    total = n.groupBy("task_id").agg(
        F.any_value("_effective").alias("effective"), F.any_value("_over").alias("_over"), F.any_value("_need").alias("_need"), estimate(F.sum("_b"), F.count(F.lit(1))).alias("before"),
        estimate(when(F.col("kept"), F.col("_b")), F.count_if("kept")).alias("after"), F.count_if(~must).alias("_optional"),
        F.array_sort(F.collect_list(F.when(~must & ~F.col("kept"), F.struct("place", "identity")))).alias("_gone"),
    )
    total = signals.join(total, "task_id", "left").withColumn("_over", F.coalesce("_over", F.lit(False)))
    effective = F.coalesce("effective", F.least("signalled", F.lit(MOST)))
    removed = F.coalesce(F.transform(F.reverse("_gone"), lambda x: x["identity"]), F.array().cast("array<string>"))
    extra = F.array_compact(F.array(
        F.when(F.col("_need") > F.col("signalled"), "required_context_floor"),
        F.when((F.col("_optional") > 0) & (effective - HEADROOM < effective) & (effective > LEAST), "final_payload_serialization_headroom"),
        F.when(F.size(removed) > 0, "optional_context_reduced_to_fit"),
    ))
    shown = lambda c: F.when(~F.col("_over"), c)
    after, before = F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0))
    summary = total.select(
        "task_id", shown(effective).alias("effective"), before.cast("long").alias("before"), shown(after).cast("long").alias("after"), shown(F.greatest(before - after, F.lit(0))).cast("long").alias("avoided"),
        shown(F.concat("reasons", extra)).alias("reasons"), shown(removed).alias("removed"), F.when(F.col("_over"), TOO_MUCH).alias("error"),
    )
    return n.select("task_id", "identity", "required", "kept"), summary


def following(references: DataFrame, results: DataFrame, kept_items: DataFrame) -> DataFrame:
    """The references (task_id, reference_id, ...) that some kept result of their task stands on."""
    kept_ids = kept_items.where("kept AND startswith(identity, 'retrieval:')").select("task_id", F.substring("identity", F.lit(11), F.length("identity")).alias("_id"))
    ids = results.select("task_id", "reference_id").distinct().join(kept_ids, (F.col("reference_id").cast("string") == F.col("_id")) & (results["task_id"] == kept_ids["task_id"]), "left_semi")
    return references.join(ids, ["task_id", "reference_id"], "left_semi")


def of_kept_paths(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Rows (task_id, path, ...) of modules, signatures or dependencies whose path a remaining file reference (task_id, kind, path) has."""
    return rows.join(references.where("kind = 'file' AND path <> ''").select("task_id", "path").distinct(), ["task_id", "path"], "left_semi")
