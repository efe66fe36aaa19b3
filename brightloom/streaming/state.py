"""Keyed state in streams: values that expire, as a cache keeps them, and the newest events of each client with counts of what was dropped.

The state is a table that each batch is folded into by joins, groups and windows; a key costs a row, not a call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists, forget, listed, shared_folder

#: How long a cached context and a pointer to one live, and how large they may be.
LIFE_SECONDS, CONTEXT_BYTES, POINTER_BYTES = 300, 256_000, 8_192
POINTER_VERSION, CACHE_VERSION = "delta-baseline-v1", "context-cache-v2"

EVENTS = "client string, event_id string, ordering_id long, event string"
BUFFERED = "client string, received long, dropped long, events array<struct<ordering_id: long, event_id: string, event: string>>"
OPS = "request_id long, op string, key string, value string, at timestamp"
ANSWERS = "request_id long, key string, at timestamp, value string"
VALUES = "key string, value string, at timestamp"


def answered(ops: DataFrame, held: DataFrame, life: int) -> tuple[DataFrame, DataFrame]:
    """((request_id, key, at, value), (key, value, at)): what each `get` of the operations finds, and each key's newest value after them.

    held: key, value, at, the newest values before. Asks are answered in the order of time, after puts of the same time, which come after what was held.
    """
    rank = F.when(F.col("op") == "get", 2).when(F.col("op") == "put", 1)
    rows = ops.select("key", "value", "at", "request_id", rank.alias("_r")).where("_r IS NOT NULL")
    rows = rows.unionByName(held.select("key", "value", "at", F.lit(None).cast("long").alias("request_id"), F.lit(0).alias("_r")))
    rows = rows.withColumn("_o", F.struct("at", "_r", F.coalesce("request_id", F.lit(2**63 - 1)).alias("i"), "value"))
    upto = Window.partitionBy("key").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last(F.when(F.col("_r") < 2, F.struct("value", "at")), ignorenulls=True).over(upto)
    asks = rows.withColumn("_n", newest).where("_r = 2")
    answers = asks.select("request_id", "key", "at", F.when(F.col("at") < F.col("_n.at") + F.expr(f"INTERVAL {life} SECONDS"), F.col("_n.value")).alias("value"))
    return answers, rows.where("_r < 2").groupBy("key").agg(F.max_by(F.struct("value", "at"), "_o").alias("_n")).select("key", "_n.value", "_n.at")


def expiring(spark: SparkSession, path: str, into: str | None = None, life: int = LIFE_SECONDS, late: str = "5 minutes", files_per_batch: int | None = 100) -> DataFrame:
    """(request_id, key, at, value): what each `get` of the operations in `path` (OPS) finds: the newest value put under its key not after it, if it is still
    alive then; null otherwise. Runs until all files are read and returns all answers so far.

    A further call with the same `into` goes on from the checkpoint with the values it holds, reading only new files. A value is freed when the stream's
    time, `late` behind the newest row of earlier batches, has passed the end of its life; rows that are later than that, or not after 1970-01-01, are not
    answered. A batch is at most `files_per_batch` files, all if None. Null keys have no values and are answered with null.
    """
    into = into or shared_folder(spark, "expiring")
    reader = spark.readStream.schema(OPS)
    ops = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path).where("at IS NOT NULL AND key IS NOT NULL")

    def keep(batch: DataFrame, number: int) -> None:
        session, before = batch.sparkSession, f"{into}/values/{number - 1}"
        going_on = exists(session, before)
        newest = session.read.schema("newest long").parquet(f"{into}/times/{number - 1}").first()[0] if going_on else None
        time = F.timestamp_micros(F.lit(0)) if newest is None else F.greatest(F.timestamp_micros(F.lit(0)), F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL '{late}'"))
        held = session.read.schema(VALUES).parquet(before) if going_on else session.createDataFrame([], VALUES)
        answers, values = answered(batch.where(F.col("at") > time), held, life)
        answers.write.mode("overwrite").parquet(f"{into}/answers/batch={number}")
        values.where(F.col("at") + F.expr(f"INTERVAL {life} SECONDS") > time).write.mode("overwrite").parquet(f"{into}/values/{number}")
        batch.agg(F.greatest(F.max(F.unix_micros("at")), F.lit(newest).cast("long")).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{into}/times/{number}")
        for table in ("values", "times"):
            forget(session, f"{into}/{table}/{number - 2}")

    run = ops.writeStream.foreachBatch(keep).option("checkpointLocation", f"{into}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(f"{ANSWERS}, batch long").parquet(f"{into}/answers").drop("batch") if exists(spark, f"{into}/answers") else spark.createDataFrame([], ANSWERS)
    none = spark.read.schema(OPS).parquet(path).where("op = 'get' AND key IS NULL AND at IS NOT NULL").select("request_id", "key", "at", F.lit(None).cast("string").alias("value"))
    return found.unionByName(none)


def folded(events: DataFrame, held: DataFrame, n: int) -> DataFrame:
    """The buffers (BUFFERED) after more events (EVENTS): a client's newest n by (ordering_id, event_id), each id once with its largest ordering id."""
    old = held.select("client", F.inline("events"))
    each = events.withColumn("_1", F.lit(1)).unionByName(old.withColumn("_1", F.lit(0))).groupBy("client", "event_id")
    each = each.agg(F.max("ordering_id").alias("ordering_id"), F.max_by("event", "ordering_id").alias("event"), F.sum("_1").alias("_1"))
    per = each.groupBy("client").agg(F.sum("_1").alias("_1"), F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("_over"))
    rank = F.row_number().over(Window.partitionBy("client").orderBy(F.desc("ordering_id"), F.desc("event_id")))
    newest = each.withColumn("_rank", rank).where(F.col("_rank") <= n)
    newest = newest.groupBy("client").agg(F.array_sort(F.collect_list(F.struct("ordering_id", "event_id", "event"))).alias("events"))
    before = held.select("client", F.col("received").alias("_received"), F.col("dropped").alias("_dropped"))
    both = newest.join(per, "client").join(before, "client", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("client", (F.col("_1") + zero("_received")).alias("received"), (F.col("_over") + zero("_dropped")).alias("dropped"), "events")


def client_buffers(spark: SparkSession, path: str, into: str | None = None, n: int = 200, files_per_batch: int = 100) -> DataFrame:
    """(client, received, dropped, events): for each client of the events in `path` (EVENTS) its newest n events as a JSON list of [ordering_id, event_id, event],
    how many rows came and how many events were dropped. Runs until all files are read.

    Of rows with one id the one with the largest ordering id counts. The buffer is the same however the events are split into batches; so is the count, as long
    as no event comes again after it was dropped, which counts as one more. Rows without a client, id or ordering id are left out. A further call with the
    same `into` goes on from the checkpoint. Each batch folds its clients into the table of the batch before; only the newest two tables are kept.
    """
    into = into or shared_folder(spark, "buffers")
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path).where("client IS NOT NULL AND event_id IS NOT NULL AND ordering_id IS NOT NULL")

    def keep(batch: DataFrame, number: int) -> None:
        session, before = batch.sparkSession, f"{into}/tables/{number - 1}"
        held = session.read.schema(BUFFERED).parquet(before) if exists(session, before) else session.createDataFrame([], BUFFERED)
        folded(batch, held, n).write.mode("overwrite").parquet(f"{into}/tables/{number}")
        forget(session, f"{into}/tables/{number - 2}")

    run = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{into}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    tables = [int(t) for t in listed(spark, f"{into}/tables")]
    held = spark.read.schema(BUFFERED).parquet(f"{into}/tables/{max(tables)}") if tables else spark.createDataFrame([], BUFFERED)
    text = F.transform("events", lambda e: F.concat(F.lit("["), e["ordering_id"].cast("string"), F.lit(","), F.substring(F.to_json(F.array(e["event_id"], e["event"])), 2, 2**31 - 1)))
    return held.withColumn("events", F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")))


def pointer_key(project: Column, task: Column, output: Column) -> Column:
    return F.concat_ws(":", F.lit("baseline"), project.cast("string"), task.cast("string"), output)


def cache_key(project: Column, input_fingerprint: Column) -> Column:
    return F.concat_ws(":", F.lit("context"), project.cast("string"), input_fingerprint)


def pointer(project: Column, task: Column, input_fingerprint: Column, output: Column, head: Column) -> Column:
    """What a baseline's pointer says: whose it is, and which context it points to; nothing of the context itself."""
    return F.to_json(F.struct(
        F.lit(POINTER_VERSION).alias("schema_version"), project.cast("string").alias("project_id"), task.cast("string").alias("task_id"),
        input_fingerprint.alias("context_input_fingerprint"), output.alias("context_output_fingerprint"), F.lower(head).alias("repository_head_sha"),
    ))


def valid_pointer(value: Column, project: Column, task: Column, output: Column) -> Column:
    """The input fingerprint that a pointer of this project, task and output names; null for what is missing, too large, corrupt or foreign."""
    said = lambda k: F.get_json_object(value, f"$.{k}")
    own = (said("schema_version") == POINTER_VERSION) & (said("project_id") == project.cast("string")) & (said("task_id") == task.cast("string")) & (said("context_output_fingerprint") == output)
    hex_ = lambda c, n: F.rlike(c, F.lit(f"^[0-9a-f]{{{n}}}$"))
    whole = hex_(said("context_input_fingerprint"), 64) & hex_(said("context_output_fingerprint"), 64) & hex_(said("repository_head_sha"), "40,64")
    return F.when((F.octet_length(value) <= POINTER_BYTES) & own & whole, said("context_input_fingerprint"))


def valid_context(value: Column, project: Column, task: Column, input_fingerprint: Column, output: Column) -> Column:
    """The context that a cached envelope of these very names holds; null otherwise."""
    said = lambda k: F.get_json_object(value, f"$.{k}")
    own = (said("schema_version") == CACHE_VERSION) & (said("project_id") == project.cast("string")) & (said("task_id") == task.cast("string"))
    own = own & (said("context_input_fingerprint") == input_fingerprint) & (said("context_output_fingerprint") == output)
    return F.when((F.octet_length(value) <= CONTEXT_BYTES) & own, said("serialized_capsule"))


def resolved_baselines(spark: SparkSession, path: str, requests: DataFrame, life: int = LIFE_SECONDS, late: str = "5 minutes") -> DataFrame:
    """(request_id, input_fingerprint, capsule, state): for each request (request_id, project_id, task_id, output, at) the baseline it names.

    `path` holds what was put under pointer and cache keys (OPS). A pointer that is not there, expired, corrupt or of another project or task does not resolve
    (NO_POINTER); nor does one whose context is not there any more, or is another (NO_CONTEXT). Both lookups are the same keyed state with expiry, run one
    after the other, each over all files at once, so that no request comes before what was put.
    """
    into = shared_folder(spark, "baselines")
    puts = spark.read.schema(OPS).parquet(path).where("op = 'put'")
    none = F.lit(None).cast("string").alias("value")
    ask = lambda df, key: df.select("request_id", F.lit("get").alias("op"), key.alias("key"), none, "at")
    of = lambda p: puts.where(F.startswith("key", F.lit(p)))
    of("baseline:").unionByName(ask(requests, pointer_key(F.col("project_id"), F.col("task_id"), F.col("output")))).write.parquet(f"{into}/first")
    first = expiring(spark, f"{into}/first", f"{into}/pointers", life, late, None)
    asked = requests.join(first.select("request_id", F.col("value").alias("_p")), "request_id", "left")
    asked = asked.withColumn("input_fingerprint", valid_pointer(F.col("_p"), F.col("project_id"), F.col("task_id"), F.col("output"))).drop("_p")
    named = asked.where("input_fingerprint IS NOT NULL")
    of("context:").unionByName(ask(named, cache_key(F.col("project_id"), F.col("input_fingerprint")))).write.parquet(f"{into}/second")
    second = expiring(spark, f"{into}/second", f"{into}/contexts", life, late, None)
    both = asked.join(second.select("request_id", F.col("value").alias("_c")), "request_id", "left")
    capsule = valid_context(F.col("_c"), F.col("project_id"), F.col("task_id"), F.col("input_fingerprint"), F.col("output"))
    state = F.when(F.col("input_fingerprint").isNull(), "NO_POINTER").when(capsule.isNull(), "NO_CONTEXT").otherwise("RESOLVED")
    return both.select("request_id", "input_fingerprint", capsule.alias("capsule"), state.alias("state"))
