"""Events as a stream: a replayable folder read once to its end, deduplicated by event id, folded by run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, forget, shared_folder


def fold(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], group: Callable[[DataFrame], DataFrame], id_col: str, into: str | None = None) -> DataFrame:
    """`group` over the events of all files of `path`, each id once; runs until all files are read and returns the table.

    State, offsets and result lie in the folder `into` of the shared storage (a new one if none is named). A further call with the same `into` goes on
    from the last batch, after a lost driver or when files came since; without new files it returns the result that is there. Each batch replaces
    the result before it, of which only one is kept, so storage does not grow with batches. Keys never expire here; a caller that may forget late copies sets a watermark in `parse`.
    """
    into = into or shared_folder(spark, "stream")
    schema = spark.read.parquet(path).schema
    unique = group(parse(spark.readStream.schema(schema).parquet(path)).dropDuplicates([id_col]))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/result/batch={number}")
        forget(spark, f"{into}/result/batch={number - 2}")

    run = unique.writeStream.outputMode("complete").option("checkpointLocation", f"{into}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    if run.lastProgress is None and not exists(spark, f"{into}/result"):
        return spark.createDataFrame([], unique.schema)  # no event at all
    every = spark.read.schema(unique.schema.add("batch", "long")).parquet(f"{into}/result")
    last = every.agg(F.max("batch").alias("n")).first()["n"]
    return every.where(F.col("batch") == (last if last is not None else -1)).drop("batch")


def valid_cursor(cursor: Column) -> Column:
    """A cursor as a long; null for what is no positive whole number in ASCII digits."""
    return F.when(F.rlike(cursor, F.lit("^[1-9][0-9]{0,18}$")), cursor.try_cast("long"))


def replay(spark: SparkSession, path: str, into: str, cursor: int = 0, id_col: str = "event_id", files_per_batch: int = 100) -> DataFrame:
    """All events after a cursor, each id once, appended to the table `into` in the shared storage; returns the table.

    A further call with the same `into` reads only files that came since and still knows the ids that went before, so a caller that was cut off
    catches up without gaps or repeats. Files with the same content under other names add nothing.
    """
    schema = spark.read.parquet(path).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).where(F.col(id_col) > cursor).dropDuplicates([id_col])
    run = new.writeStream.outputMode("append").format("parquet").option("path", f"{into}/events").option("checkpointLocation", f"{into}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{into}/events")


def frames(events: DataFrame, id_col: str, kind: str, *data: str) -> DataFrame:
    """(id, frame): events as server-sent events; the data is JSON with sorted keys, so equal events have equal frames."""
    body = F.to_json(F.struct(*sorted(data)))
    return events.select(id_col, F.concat(F.lit("id: "), F.col(id_col).cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))
