"""Git as tables, from what its commands print (captured to files, read with binaryFile or text): index listings, changed paths, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _records(captured: DataFrame, project: str, content: str) -> DataFrame:
    text = F.coalesce(F.try_validate_utf8(F.col(content).cast("string")), F.raise_error(F.lit("a path is not UTF-8")).cast("string"))
    return captured.select(project, F.explode(F.split(text, "\u0000")).alias("_r")).where("_r <> ''")


def index_entries(captured: DataFrame, project: str = "project_id", content: str = "content") -> DataFrame:
    """(project, mode, sha, path, is_link) of `git ls-files --stage -z`. An unmerged, malformed or repeated entry is an error, so no part of a bad index is taken for it."""
    shape = r"(?s)^([0-7]{6}) ([0-9a-fA-F]{40}|[0-9a-fA-F]{64}) 0\t(.+)$"
    r, of = F.col("_r"), lambda n: F.regexp_extract("_r", shape, n)
    path = F.when(F.rlike(r, F.lit(shape)), of(3)).otherwise(F.raise_error(F.lit("the index has an unmerged or malformed entry")).cast("string"))
    found = _records(captured, project, content).select(project, of(1).alias("mode"), F.lower(of(2)).alias("sha"), path.alias("path"))
    once = found.groupBy(project, "path").agg(F.min("mode").alias("mode"), F.min("sha").alias("sha"), F.count(F.lit(1)).alias("_n"))
    sha = F.when(F.col("_n") == 1, F.col("sha")).otherwise(F.raise_error(F.lit("the index has a path twice")).cast("string"))
    return once.select(project, "mode", sha.alias("sha"), "path", (F.col("mode") == "160000").alias("is_link"))


def changed_paths(captured: DataFrame, project: str = "project_id", content: str = "content") -> DataFrame:
    """(project, path) of `git status --porcelain=v1 -z`: each path that differs, once."""
    path = F.when(F.substring("_r", 3, 1) == " ", F.substr("_r", F.lit(4))).otherwise(F.col("_r"))
    return _records(captured, project, content).select(project, path.alias("path")).distinct()


def with_state(entries: DataFrame, changed: DataFrame, project: str = "project_id") -> DataFrame:
    """Index entries with MODIFIED or CLEAN."""
    c = changed.select(project, "path", F.lit(True).alias("_c"))
    return entries.join(c, [project, "path"], "left").withColumn("state", F.when(F.col("_c"), "MODIFIED").otherwise("CLEAN")).drop("_c")


def commits(lines: DataFrame, line: str = "value") -> DataFrame:
    """The columns of `lines` with sha, short_sha, occurred_at and subject of `git log --format=%H%x1f%aI%x1f%s`; other lines are left out, a bad date is null."""
    f = F.split(line, "\u001f", 3)
    kept = lines.where((F.size(f) == 3) & (F.length(f[0]) == 40))
    keep = [c for c in lines.columns if c != line]
    return kept.select(*keep, F.lower(f[0]).alias("sha"), F.lower(F.left(f[0], F.lit(7))).alias("short_sha"), F.try_to_timestamp(f[1]).alias("occurred_at"), F.trim(f[2]).alias("subject"))
