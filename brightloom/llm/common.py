"""Helpers that the operators share: lineage cuts, held-out folds, running sums without a hot task."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType()}


def fields(spec: str) -> T.StructType:
    """A schema from `name kind, ...`, a kind with [] being an array. Unlike a DDL string it needs no session, so workers can import it."""
    kind = lambda k: T.ArrayType(_KINDS[k[:-2]]) if k.endswith("[]") else _KINDS[k]
    return T.StructType([T.StructField(name, kind(k)) for name, k in (x.split() for x in spec.split(","))])


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master (tests) may leave it unset and gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return f"{named.rstrip('/')}/brightloom-{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that operators of this application wrote to the shared folder. Call it when their results are written: those read from them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are kept in the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """Like settle(), as a Parquet table: its size is known to the planner, which broadcasts it only below its own threshold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_at_once(spark: SparkSession, rows: int) -> SparkSession:
    """A session beside this one, for tables whose rows are large: its Python workers get `rows` of them at a time. Settings of the caller's session stay as they are."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return beside


def stored(df: DataFrame, what: str, group_rows: int | None = None) -> str:
    """Write the rows to the shared folder; the path, from which any session can read them.

    group_rows: how many rows are held at once when they are written and read, for large rows; by itself Parquet looks at its memory after a hundred.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return path


def top_per(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """The first k rows of each group with their rank. A group is cut down in `salts` parts first, so a very large one is never sorted by one task."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    some = df.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_n") <= k)
    every = some.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return every.where(F.col(rank) <= k).drop("_n", "_salt")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows that nothing may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fold_bits(n_rows: int) -> int:
    """Bits of a hash that split n rows into about sqrt(n) ranges of about sqrt(n) rows each."""
    return max(1, min(24, math.ceil(math.log2(max(n_rows, 2)) / 2)))


def hash_range(key: Column, bits: int) -> Column:
    """The range of a 64-bit hash, by its top bits. Ranges follow the order of the hash read as unsigned."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int")


def running_sum(df: DataFrame, group: list[str], part: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one in its group, by (part, order).

    `part` cuts a group into consecutive ranges, so a group with a third of all rows is spread over many tasks: the ranges' totals
    (one row per range) are accumulated first, then each range is accumulated on its own. Also adds `<out>_row`, the row's number in its range.
    """
    keys = [*group, part]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*keys).orderBy(*order)
    inside = F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = df.join(totals, keys)
    return joined.select("*", (F.col("_base") + inside).cast("long").alias(out), F.row_number().over(own).cast("long").alias(f"{out}_row")).drop("_base")


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
