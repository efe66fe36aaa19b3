"""A training corpus from raw documents in five stages; each works on all that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import exact_dedup, langid, mixing, packing, resemblance, simhash
from brightloom.llm.common import shared_dir, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The number of a row, which tells apart rows whose ids are null or repeat.
ROW = "pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, ROW. The first stage writes it with its result; a table that comes without it is written here, as the numbers must not change between two reads."""
    return docs.select(*COLUMNS, ROW) if ROW in docs.columns else written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), "rows")


def order_of(text: Column) -> Column:
    """What the row that stays is least by: its id, null last; rows that repeat an id by their texts, then by number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), F.col(ROW).alias("row"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose row numbers are not in `dropped`. The numbers are written first, so the planner knows their size: few are broadcast, many are joined by shuffle."""
    return docs.join(written(dropped.select(F.col("row").alias("_drop")), "dropped"), F.col(ROW) == F.col("_drop"), "left_anti").select(*COLUMNS, ROW)


def beside_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(row): the rows that go of groups given as (node, root), roots left out: all but the least of each group."""
    every = written(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")
    named = docs.join(every, F.col(ROW) == F.col("node")).select("root", order_of(F.col("text")).alias("order"))
    named = written(named, "named")
    stays = written(named.groupBy("root").agg(F.min("order").alias("least")), "stays")
    return named.join(stays, "root").where("order.row <> least.row").select("order.row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or no letter) go; the rest carry the language found (operator 7).

    Empty texts go with those without a letter; texts of any length are read whole; ties go to the first language by name. Rows with null or repeated
    ids, and equal rows, are rows of their own. An empty table stays empty. Columns besides those of documents are left behind, whatever their names.
    """
    found = langid.language_of(docs, carry=("text", "source", "n_chars"))
    found = found.where(F.col("lang_pred") != langid.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")
    return found.withColumn(ROW, F.monotonically_increasing_id())


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in either case), one row stays: the one with the smallest id (operator 6).

    A null id stays only where its group has no other; of rows that repeat an id one stays as well. A null text counts as empty; all texts are compared
    whole. Columns besides those of documents are left behind. An empty table stays empty.
    """
    docs = numbered(docs)
    keyed = docs.select(order_of(F.col("text")).alias("_key"), "text")
    return without(docs, exact_dedup.exact_duplicates(keyed, id_col="_key", keep="min").where("NOT kept").select("_key.row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one row stays: the one with the smallest id (operator 4, five words, similarity of 0.8 or more).

    SimHash links are confirmed by the share of equal shingles, and so is what bands find beyond their reach. Null and repeated ids, null, empty and very
    long texts, repeated rows, empty tables and other columns: as in drop_copies().
    """
    docs = numbered(docs)
    links = simhash.near_links(docs, ROW, width=5)
    return without(docs, beside_least(docs, resemblance.near_copies(docs, ROW, width=5, similarity=0.8, first=links)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row per pass over their source in which at least half of their words are taken (operator 8).

    Rows count by themselves, whatever their ids. A null source is a source; null and empty texts have no words and are never taken; a text of any length
    is taken whole or not at all. An empty table stays empty. Columns besides those of documents are left behind, whatever their names.
    """
    docs = numbered(docs)
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("end") - F.col("start")))
    taken = mixing.mix(docs, carry=(ROW,)).where("pass IS NOT NULL").groupBy(ROW, "pass", "size").agg(words.alias("words"))
    taken = taken.where("words * 2 >= size").groupBy(ROW).agg(F.count(F.lit(1)).cast("int").alias("times"))
    taken = written(taken.withColumnRenamed(ROW, "_taken"), "taken")
    # Nearly every document is taken, so the counts grow with the documents: the same merge join at every size.
    both = docs.join(taken.hint("merge"), F.col(ROW) == F.col("_taken"))
    return both.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).select(*COLUMNS)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches: a row per piece with its bucket, batch and slot (operator 9). Null and empty texts are a piece of no words; long ones are cut, none is dropped; all else as in packing.pack()."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

#: Rank-order language ID, shingle similarity and the hash-shuffled schedule are not SQL; tests/llm/test_pipeline.py holds the stages against plain Python versions and tries run() with null and repeated ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    into = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{into}/{name}")
        docs = spark.read.parquet(f"{into}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
