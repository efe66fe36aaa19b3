"""The evidence loop of disclosure: for many tasks at once, the level a task's words ask for, raised while what that level shows lacks what the task names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, symbol_mentions
from ..session import kept
from .code import mentioned_paths
from .disclosure import BOUNDS, EXCERPT_CHARS

#: Phrases by the level that they ask for, highest first, and phrases of a task that implements something.
PHRASES = {
    5: ("repository-wide", "entire repository", "all tracked files", "repository investigation", "repository-wide investigation"),
    4: ("complete file", "entire file", "full file", "whole file"),
    3: ("implementation excerpt", "implementation excerpts", "implementation evidence", "source excerpt", "function body"),
    2: ("symbol signature", "symbol signatures", "qualified symbol", "dependency metadata"),
    1: ("module summary", "module summaries"),
}
IMPLEMENTATION = ("implement", "implementation", "refactor", "function", "module summary", "module summaries", "symbol", "excerpt", "signature", "complete file", "source excerpt", "fix the", "build the", "build a")
#: The most characters of a step's evidence, and why a task is refused.
EVIDENCE_CHARS, UNRESOLVED, FOREIGN = 160, "l4_target_unresolved", "cross_project_disclosure_evidence"


def short(name: Column) -> Column:
    """The last part of a dotted name."""
    return F.element_at(F.split(name, r"\."), -1)


def asked_level(text: Column) -> Column:
    """The level that a text's words ask for: by phrases, symbols and paths that it names; 0 if by nothing."""
    said = {n: contains_phrase(F.array(*map(F.lit, p)), text) for n, p in PHRASES.items()}
    said[2] = said[2] | (F.size(symbol_mentions(text)) > 0)
    said[1] = said[1] | (F.size(mentioned_paths(text)) > 0)
    return F.coalesce(*[F.when(cond, n) for n, cond in said.items()], F.lit(0))


def starting_levels(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """(task_id, start): the level asked for, at least the one requested; a task that implements something and asks for none gets one by what was found for it."""
    kind, has = F.col("kind"), lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = items.groupBy("task_id").agg(
        has(kind.isin("symbol", "result") & F.col("symbol").isNotNull() | (kind == "test")).alias("_s"), has(kind.isin("file", "result") & F.col("path").isNotNull()).alias("_f")
    )
    text = F.concat_ws(" ", "heading", "wanted")
    level, builds = asked_level(text), contains_phrase(F.array(*map(F.lit, IMPLEMENTATION)), text)
    by = F.when((level == 0) & builds, F.when(F.coalesce("_s", F.lit(False)), 2).when(F.coalesce("_f", F.lit(False)), 1).otherwise(0)).otherwise(0)
    return tasks.join(found, "task_id", "left").select("task_id", F.greatest(level, by, F.coalesce("requested", F.lit(0))).cast("int").alias("start"))


def first_of(items: DataFrame, kind: str, most: int | None) -> DataFrame:
    """A task's items of a kind with their rank, the first `most` of them."""
    n = F.row_number().over(Window.partitionBy("task_id").orderBy("order"))
    found = items.where(F.col("kind") == kind).select("task_id", "path", "symbol", "snippet", n.alias("rank"))
    return found if most is None else found.where(F.col("rank") <= most)


def presented_symbols(tasks: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """(task_id, project_id, path, symbol, rank): the symbols that are shown: those found, then such as the task mentions and a shown file defines, eight in all.

    A mention is met by its very name, else by the last definition in the file with its last part. tasks: task_id, project_id, mentions.
    """
    most = BOUNDS["symbol"][2]
    base = first_of(items, "symbol", most)
    donors = base.select("task_id", "path").unionByName(first_of(items, "file", BOUNDS["module"][2]).select("task_id", "path")).where("path IS NOT NULL").distinct()
    asked = tasks.select("task_id", "project_id", F.explode("mentions").alias("mention")).withColumn("short", short(F.col("mention")))
    met = asked.join(donors, "task_id").join(names, ["project_id", "path", "short"]).groupBy("task_id", "path", "mention")
    met = met.agg(F.max_by("name", F.struct(F.col("name") == F.col("mention"), "line")).alias("symbol"))
    met = met.groupBy("task_id", "path", "symbol").agg(F.min("mention").alias("mention")).join(base.select("task_id", "path", "symbol"), ["task_id", "path", "symbol"], "left_anti")
    have = base.groupBy("task_id").agg(F.count(F.lit(1)).alias("_n"))
    at = F.row_number().over(Window.partitionBy("task_id").orderBy("path", "mention")) + F.coalesce("_n", F.lit(0))
    added = met.join(have, "task_id", "left").select("task_id", "path", "symbol", at.cast("int").alias("rank")).where(F.col("rank") <= most)
    every = base.select("task_id", "path", "symbol", "rank").unionByName(added)
    return every.join(tasks.select("task_id", "project_id"), "task_id")


def signatures_of(shown: DataFrame, names: DataFrame) -> DataFrame:
    """(task_id, rank, path, name): the definition of each shown symbol in its file: its very name, else the first nested one with its last part."""
    both = shown.withColumn("short", short(F.col("symbol"))).join(names, ["project_id", "path", "short"])
    both = both.where((F.col("name") == F.col("symbol")) | F.contains("name", F.lit(".")))
    best = F.min_by("name", F.struct(F.col("name") != F.col("symbol"), "line"))
    return both.groupBy("task_id", "rank", "path").agg(best.alias("name"))


def _evidence(names: Column) -> Column:
    return F.left(F.array_join(F.array_sort(names), " "), F.lit(EVIDENCE_CHARS))


def lacking_signatures(tasks: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """(task_id, reason, evidence) of tasks that mention symbols of which no shown signature has the name or its last part."""
    shown = signatures_of(presented_symbols(tasks, items, names), names).select("task_id", short(F.col("name")).alias("short")).distinct()
    asked = tasks.select("task_id", F.explode("mentions").alias("mention")).withColumn("short", short(F.col("mention")))
    missing = asked.join(shown, ["task_id", "short"], "left_anti").groupBy("task_id").agg(F.collect_set("mention").alias("m"))
    return missing.select("task_id", F.lit("required_signature_unresolved").alias("reason"), _evidence(F.col("m")).alias("evidence"))


def lacking_excerpts(tasks: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """(task_id, reason, evidence) of tasks that mention symbols which the project defines, but the shown excerpts name neither whole nor by their last part."""
    shown = first_of(items, "result", BOUNDS["excerpt"][3]).select("task_id", F.left("snippet", F.lit(EXCERPT_CHARS)).alias("snippet"))
    asked = tasks.select("task_id", "project_id", F.explode("mentions").alias("mention")).withColumn("short", short(F.col("mention")))
    named = asked.join(shown, "task_id").where(F.contains("snippet", F.col("short"))).select("task_id", "mention").distinct()
    missing = asked.join(named, ["task_id", "mention"], "left_anti").join(names.select("project_id", "short").distinct(), ["project_id", "short"], "left_semi")
    missing = missing.groupBy("task_id").agg(F.collect_set("mention").alias("m"))
    return missing.select("task_id", F.lit("implementation_excerpt_unavailable").alias("reason"), _evidence(F.col("m")).alias("evidence"))


def complete_files(tasks: DataFrame, items: DataFrame, files: DataFrame, names: DataFrame, most: int = BOUNDS["file"][4]) -> tuple[DataFrame, DataFrame]:
    """((task_id, rank, path), (task_id, error)): the files that tasks are shown whole, and why some have none.

    These are the paths that the task's wanted text names, of which none may be outside the project; else files found for it that define a symbol named
    there; else files of the project that do; without such names, all files found for it.
    """
    tracked = files.select("project_id", "path").distinct()
    t = tasks.select("task_id", "project_id", mentioned_paths(F.col("wanted")).alias("paths"), F.transform(symbol_mentions(F.col("wanted")), short).alias("shorts"))
    named = t.select("task_id", "project_id", F.explode("paths").alias("path"))
    foreign = named.join(tracked, ["project_id", "path"], "left_anti").select("task_id").distinct().withColumn("error", F.lit(FOREIGN))
    named = named.select("task_id", F.lit(0).alias("way"), F.lit(0).alias("at"), "path")
    rest = t.where("size(paths) = 0").select("task_id", "project_id", "shorts")
    order = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "symbol", 1).when(F.col("kind") == "result", 2)
    seen = items.where(order.isNotNull() & F.col("path").isNotNull()).select("task_id", "path", F.struct(order.alias("k"), F.col("order").alias("o")).alias("at"))
    seen = rest.join(seen.groupBy("task_id", "path").agg(F.min("at").alias("at")), "task_id").join(tracked, ["project_id", "path"], "left_semi")
    seen = seen.select("task_id", "project_id", "path", F.row_number().over(Window.partitionBy("task_id").orderBy("at", "path")).alias("at"), F.size("shorts").alias("n"))
    asked = rest.select("task_id", "project_id", F.explode("shorts").alias("short"))
    # A short name may be defined in every file of a project: tasks meet only the files found for them, and the first paths of each name, which hold the first of any names.
    defining = names.select("project_id", "path", "short").distinct()
    own = seen.where("n > 0").join(asked.select("task_id", "short"), "task_id").join(defining, ["project_id", "path", "short"], "left_semi")
    own = own.select("task_id", F.lit(1).alias("way"), "at", "path").distinct()
    first = defining.withColumn("r", F.row_number().over(Window.partitionBy("project_id", "short").orderBy("path"))).where(F.col("r") <= most).drop("r")
    project = asked.join(first, ["project_id", "short"]).select("task_id", "path").distinct()
    project = project.withColumn("r", F.row_number().over(Window.partitionBy("task_id").orderBy("path"))).where(F.col("r") <= most)
    project = project.select("task_id", F.lit(2).alias("way"), F.col("r").alias("at"), "path")
    any_ = seen.where("n = 0").select("task_id", F.lit(3).alias("way"), "at", "path")
    every = named.unionByName(own).unionByName(project).unionByName(any_).join(foreign, "task_id", "left_anti")
    least = every.groupBy("task_id").agg(F.min("way").alias("way"))
    every = every.join(least, ["task_id", "way"])
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("at", "path"))
    chosen = every.select("task_id", rank.cast("long").alias("rank"), "path").where(F.col("rank") <= most)
    none = t.select("task_id").join(chosen, "task_id", "left_anti").join(foreign, "task_id", "left_anti").withColumn("error", F.lit(UNRESOLVED))
    return chosen, foreign.unionByName(none)


def disclose(tasks: DataFrame, items: DataFrame, files: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((task_id, start, level, steps, error), (task_id, rank, path)): where each task's disclosure ends, step by step, and the files shown whole.

    tasks: task_id, project_id, heading (title and constraints), wanted (criteria and text), requested (a level or null). items: task_id, kind (file, symbol,
    test, result), order, path, symbol, snippet. files: project_id, path. outlines: project_id, path, qualified_name, line_start. Missing texts are empty.

    A level only rises, and a task whose level suffices is settled, so each round takes up the tasks that stand at its level and raises those that lack
    something by one; after the last level with a check all are settled. Rounds are written, so no plan grows. Mentions meet definitions by equality of
    names or last parts. A task at level 4 or 5 without a file to show whole, or that names one outside its project, carries an error.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    tasks = tasks.select("task_id", "project_id", blank(F.col("heading")).alias("heading"), blank(F.col("wanted")).alias("wanted"), "requested")
    tasks = tasks.withColumn("mentions", symbol_mentions(F.concat_ws(" ", "heading", "wanted")))
    names = kept(outlines.select("project_id", "path", F.col("qualified_name").alias("name"), short(F.col("qualified_name")).alias("short"), F.col("line_start").alias("line")), "names")
    step = "struct<from:int,to:int,reason:string,evidence:string>"
    state = kept(tasks.join(starting_levels(tasks, items), "task_id").withColumn("level", F.col("start")).withColumn("steps", F.array().cast(f"array<{step}>")), "state")
    for level, check in ((2, lacking_signatures), (3, lacking_excerpts)):
        open_ = state.where((F.col("level") == level) & (F.size("mentions") > 0)).select("task_id", "project_id", "mentions")
        found = check(open_, items.join(open_.select("task_id"), "task_id", "left_semi"), names)
        raised = F.col("reason").isNotNull()
        one = F.array(F.struct(F.col("level").alias("from"), (F.col("level") + 1).alias("to"), "reason", "evidence")).cast(f"array<{step}>")
        state = state.join(found, "task_id", "left").withColumn("steps", F.when(raised, F.concat("steps", one)).otherwise(F.col("steps")))
        state = kept(state.withColumn("level", F.when(raised, F.col("level") + 1).otherwise(F.col("level"))).drop("reason", "evidence"), "state")
    deep = state.where("level >= 4")
    chosen, errors = complete_files(deep, items.join(deep.select("task_id"), "task_id", "left_semi"), files, names)
    return state.join(errors, "task_id", "left").select("task_id", "start", "level", "steps", "error"), chosen
