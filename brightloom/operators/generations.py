"""A corpus in generations: sources are chunked and compared with what is current, changes are appended, and one manifest publishes them all at once.

A folder holds chunks/, changes/, manifests/ and ledger/. What a run has written counts only once its manifest is there, so a run that fails anywhere leaves
the last generation current; each generation can be read again later, and the changes are its history.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import list_fingerprint, sha256_text
from ..session import kept, listed, publish
from .corpus import chunks

#: The version of the chunker, which is part of a reference's identity.
CHUNKER = "lines-v1"
TASK = "TASK"
FIELDS = ("source_kind", "source_id", "path", "title", "symbol", "base_line", "base_char")
MANIFEST = (
    "generation long, run_id string, at timestamp, repository_fingerprint string, task_fingerprint string, fingerprint string, chunks long, new_chunks long, reused_chunks long, "
    "references long, repository_references long, task_references long, new_references long, reused_references long, removed_references long"
)
LEDGER = "run_id string, seq long, status string, at timestamp, error string"


def united(files: DataFrame, symbols: DataFrame, tasks: DataFrame) -> DataFrame:
    """The sources of a corpus: files and symbols of the repository, and tasks. Columns that a side lacks are null; source_kind says where a row is from."""
    sides = ((files, "REPOSITORY_FILE"), (symbols, "REPOSITORY_SYMBOL"), (tasks, TASK))
    every = [df.withColumn("source_kind", F.lit(kind)) for df, kind in sides]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
    for c, t in (("path", "string"), ("title", "string"), ("symbol", "string"), ("base_line", "long"), ("base_char", "long")):
        whole = whole if c in whole.columns else whole.withColumn(c, F.lit(None).cast(t))
    return whole.select(*[F.col(c).cast("long" if c.startswith("base") else "string").alias(c) for c in FIELDS], "text")


def desired(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((fingerprint, chunk, fields, ordinal, places), (chunk, content)): the references that the sources make, each once, and the texts of their chunks.

    Sources of one kind and id count once if they are equal in all fields and text. Null and empty texts make no reference.
    """
    rows = sources.withColumn("source_sha256", sha256_text(F.coalesce("text", F.lit("")))).dropDuplicates([*FIELDS, "source_sha256"])
    rows = kept(rows.where("text <> ''").withColumn("_row", F.xxhash64(*FIELDS, "source_sha256").cast("string")), "sources")
    each = rows.join(chunks(rows, "_row", "text").withColumnRenamed("sha256", "chunk"), "_row")
    places = ("ordinal", "start_line", "end_line", "start_char", "end_char")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*FIELDS, "source_sha256", *places, "chunk")]
    each = each.withColumn("fingerprint", list_fingerprint(F.lit(CHUNKER), *said)).withColumn("content", F.substring("text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")))
    each = kept(each.dropDuplicates(["fingerprint"]).select("fingerprint", "chunk", *FIELDS, *places, "content"), "references")
    texts = each.groupBy("chunk").agg(F.any_value("content").alias("content"))
    return each.drop("content"), texts


def content_fingerprint(of: Column) -> tuple[Column, Column]:
    """Two sums over the hash of what the rows say, as one fingerprint needs them: the same in any order, combined before a shuffle."""
    lane = lambda at: F.coalesce(F.sum(F.conv(F.substring(of, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return lane(1), lane(16)


def fingerprints(sources: DataFrame) -> dict[str, str]:
    """The fingerprints of the repository's sources, of tasks, and of both; nothing of a run is in them, so equal sources have equal ones."""
    said = list_fingerprint(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*FIELDS, "text")])
    rows = sources.select((F.col("source_kind") == TASK).alias("task"), said.alias("h")).distinct()
    sides = [F.when(F.col("task") == side, F.col("h")) for side in (False, True)]
    sums = [c for side in sides for c in content_fingerprint(side)]
    r = rows.agg(*[c.alias(f"_{i}") for i, c in enumerate(sums)])
    r = r.select(list_fingerprint(F.col("_0"), F.col("_1")).alias("repository"), list_fingerprint(F.col("_2"), F.col("_3")).alias("task"))
    return r.select("*", list_fingerprint(F.col("repository"), F.col("task")).alias("both")).first().asDict()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row per published generation."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifests") if listed(spark, f"{path}/manifests") else spark.createDataFrame([], MANIFEST)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What became of each run: rows are only ever added."""
    return spark.read.schema(LEDGER).json(f"{path}/ledger") if listed(spark, f"{path}/ledger") else spark.createDataFrame([], LEDGER)


def _published(spark: SparkSession, path: str, table: str, generation: int | None) -> DataFrame | None:
    """The rows of a table that published runs wrote, with their generation; runs that are not published, or come later, are not read."""
    runs = {r.run_id: r.generation for r in manifests(spark, path).collect() if generation is None or r.generation <= generation}  # one a generation
    if not runs:
        return None
    number = spark.createDataFrame(list(runs.items()), "run string, generation long")
    return spark.read.option("basePath", f"{path}/{table}").schema(_SCHEMAS[table]).parquet(*[f"{path}/{table}/run={r}" for r in runs]).join(F.broadcast(number), "run")


_REFERENCE = "fingerprint string, chunk string, source_kind string, source_id string, path string, title string, symbol string, base_line long, base_char long, ordinal long, start_line long, end_line long, start_char long, end_char long"
_SCHEMAS = {"changes": f"{_REFERENCE}, action string, run string", "chunks": "chunk string, content string, run string"}


def as_of(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The references that are current in a generation (the newest if none is named): those whose last change up to it is no removal."""
    changes = _published(spark, path, "changes", generation)
    if changes is None:
        return spark.createDataFrame([], _REFERENCE)
    fields = [c for c in changes.columns if c not in ("run", "generation", "action")]
    last = changes.groupBy("fingerprint").agg(F.max_by(F.struct(*fields, "action"), "generation").alias("x"))
    return last.select("x.*").where("action = 'insert'").drop("action")


def chunk_texts(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """(chunk, content) of all chunks stored up to a generation."""
    found = _published(spark, path, "chunks", generation)
    return spark.createDataFrame([], "chunk string, content string") if found is None else found.select("chunk", "content")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(generation, fingerprint, action, source_kind, source_id): every change of every published generation."""
    found = _published(spark, path, "changes", None)
    none = "generation long, fingerprint string, action string, source_kind string, source_id string"
    return spark.createDataFrame([], none) if found is None else found.select("generation", "fingerprint", "action", "source_kind", "source_id")


def sync(spark: SparkSession, path: str, sources: DataFrame, run_id: str, at: str) -> dict:
    """Make the sources (as united() gives them) the next generation; its manifest as a dict.

    References of the sources that are not current are inserted, current ones that the sources lack are removed; what is unchanged is not written. Chunks
    are stored once, whatever generation brings them. If anything fails, or another run publishes this generation first, the ledger says FAILED, the error
    is raised, and the last generation stays current. `run_id` is new for each run; `at` is its time, as ISO 8601.
    """
    note = lambda seq, status, error=None: publish(spark, f"{path}/ledger/{run_id}-{seq}.json", json.dumps({"run_id": run_id, "seq": seq, "status": status, "at": at, "error": error}))
    note(0, "RUNNING")
    try:
        generation = (manifests(spark, path).agg(F.max("generation")).first()[0] or 0) + 1
        wanted, texts = desired(sources)
        before = as_of(spark, path, generation - 1)
        new = wanted.join(before.select("fingerprint"), "fingerprint", "left_anti").withColumn("action", F.lit("insert"))
        gone = before.join(wanted.select("fingerprint"), "fingerprint", "left_anti").withColumn("action", F.lit("delete"))
        new.unionByName(gone).write.parquet(f"{path}/changes/run={run_id}")
        texts.join(chunk_texts(spark, path, generation - 1).select("chunk"), "chunk", "left_anti").write.parquet(f"{path}/chunks/run={run_id}")
        read = lambda table: spark.read.schema(_SCHEMAS[table]).parquet(f"{path}/{table}/run={run_id}")
        c = read("changes").agg(F.count_if(F.col("action") == "insert").alias("new"), F.count_if(F.col("action") == "delete").alias("gone")).first()
        w = wanted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_kind") == TASK).alias("tasks"), F.count_distinct("chunk").alias("chunks")).first()
        stored, said = read("chunks").count(), fingerprints(sources)
        manifest = {
            "generation": generation, "run_id": run_id, "at": at, "repository_fingerprint": said["repository"], "task_fingerprint": said["task"], "fingerprint": said["both"], "chunks": w.chunks, "new_chunks": stored,
            "reused_chunks": w.chunks - stored, "references": w.n, "repository_references": w.n - w.tasks, "task_references": w.tasks, "new_references": c.new, "reused_references": w.n - c.new, "removed_references": c.gone,
        }
        publish(spark, f"{path}/manifests/{generation:08}.json", json.dumps(manifest))
    except Exception as e:
        note(1, "FAILED", str(e)[:512])
        raise
    note(1, "COMPLETED")
    return manifest
