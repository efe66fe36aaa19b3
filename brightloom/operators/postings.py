"""A stored index of lexemes: documents with their lexemes in order, and postings in blocks with the most that a document of the block can score.

Both searches ask for many queries at once. They take candidates from rare lexemes, score them exactly, and go on only where a bound says that something
better may be left; postings of common lexemes stay unread as far as the results allow.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import basename, identifier_tokens, search_text, words
from ..session import kept, shared_folder, ship
from .retrieval import cover_density

#: The boosts of exact names and the weight of words in names.
BOOSTS = {"symbol": 4.0, "path": 3.0, "basename": 2.0, "title": 1.5, "symbol_prefix": 1.0}
COVER, METADATA_WEIGHT = 0.1, 1.5
#: The longest query; documents of a block; most parts by lexeme; blocks of a query that are scored before there is a threshold.
QUERY_CHARS, BLOCK, PARTS, FIRST_BLOCKS = 512, 4096, 1024, 4


def lexemes(text: Column) -> Column:
    """What a text is found by: its words, and after them the pieces of its identifiers."""
    return words(search_text(F.coalesce(text, F.lit(""))))


def normalised_queries(queries: DataFrame) -> DataFrame:
    """(query_id, raw, basename, tokens, fault): distinct pieces of the identifiers in a query; fault is blank, long or no_words, null for a query that can be asked."""
    raw = F.trim(F.coalesce("query", F.lit("")))
    tokens = F.array_distinct(identifier_tokens(raw))
    fault = F.when(raw == "", "blank").when(F.length(raw) > QUERY_CHARS, "long").when(F.size(tokens) == 0, "no_words")
    return queries.select("query_id", F.lower(raw).alias("raw"), F.lower(F.regexp_replace(raw, r"^.*[\\/]", "")).alias("basename"), tokens.alias("tokens"), fault.alias("fault"))


class Index(NamedTuple):
    """Where an index lies, the name of its documents as a table bucketed by id, in how many parts its postings are, and the columns of its two tables."""

    path: str
    table: str
    parts: int
    document: StructType
    posting: StructType

    def documents(self, spark: SparkSession) -> DataFrame:
        """The documents; an application other than the one that built the index has no buckets and reads the files."""
        return spark.table(self.table) if spark.catalog.tableExists(self.table) else spark.read.schema(self.document).parquet(f"{self.path}/documents")


class Unindexed(NamedTuple):
    """Documents (id, c) for a single search, which does not pay for a stored index: postings are read off the documents."""

    forward: DataFrame

    def documents(self, spark: SparkSession) -> DataFrame:
        return self.forward


def build(docs: DataFrame, path: str, content: Column, names: Column | None = None, payload: Sequence[str] = (), group: Column | None = None, keys: Column | None = None, block: int = BLOCK) -> Index:
    """Write the index of docs (id and other columns) to a folder.

    `content` and `names` are arrays of lexemes; `payload` are columns to return; of rows with one `group` a search keeps the best; `keys` are names by
    which a row is found whole. Ids do not repeat and are not null. Postings of a lexeme are cut into blocks of about `block` documents by a hash of the
    id, so the commonest lexeme is many rows, and no task gathers more than a block of it.

    Documents are dealt by id once, before they are cut into lexemes, and kept in buckets of whole blocks: a lexeme is counted and its ids are gathered
    where its documents lie, so lists of ids are shuffled and never single lexemes, and searches join the documents without moving them.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-docs.select("id").count() // block))
    parts, buckets = min(PARTS, blocks), min(PARTS, max(blocks, spark.sparkContext.defaultParallelism))
    none = F.array().cast("array<string>")
    whole = docs.repartition(buckets, "id").select(
        "id", content.alias("c"), (none if names is None else names).alias("m"), F.struct(*payload).alias("row") if payload else F.lit(None).cast("string").alias("row"),
        (F.col("id").cast("string") if group is None else group).alias("group"), (none if keys is None else F.array_distinct(keys)).alias("keys"),
    )
    table = f"documents_{uuid.uuid4().hex}"
    whole.write.bucketBy(buckets, "id").option("path", f"{path}/documents").saveAsTable(table)
    rows = inverted(spark.table(table), buckets, -(-blocks // buckets)).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    rows.repartition("part", "block").sortWithinPartitions("part", "term", "block").write.partitionBy("part").parquet(f"{path}/postings")
    return Index(path, table, parts, whole.schema, rows.schema)


def inverted(forward: DataFrame, buckets: int, within: int) -> DataFrame:
    """(term, block, n, most, ids) of documents (id, c, m) in buckets by id: blocks divide the buckets by the same hash, `within` to each."""
    each = forward.select("id", F.size("c").alias("inside"), F.posexplode(F.concat("c", "m")).alias("at", "term"))
    each = each.groupBy("id", "term").agg(F.sum(F.when(F.col("at") < F.col("inside"), COVER).otherwise(COVER * METADATA_WEIGHT)).alias("most"))
    block = F.pmod(F.hash("id"), F.lit(buckets)).cast("long") * within + F.pmod(F.xxhash64("id"), F.lit(within))
    rows = each.withColumn("block", block).groupBy("term", "block")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most"), F.collect_list("id").alias("ids"))


def unindexed(docs: DataFrame, content: Column) -> Unindexed:
    """Documents with their distinct lexemes, cut once; ids do not repeat and are not null."""
    return Unindexed(kept(docs.select("id", content.alias("c")), "documents"))


def postings_of(spark: SparkSession, index: Index | Unindexed, terms: DataFrame) -> DataFrame:
    """The postings of the terms (term, ...): the part of a term is known, so only parts that are asked for are read."""
    if isinstance(index, Unindexed):
        each = index.forward.select(F.explode("c").alias("term"), F.array("id").alias("ids"), F.lit(1).cast("long").alias("n"))
        return each.join(terms, "term")
    part = F.pmod(F.xxhash64("term"), F.lit(index.parts)).cast("int")
    return spark.read.schema(index.posting).parquet(f"{index.path}/postings").join(terms.withColumn("part", part), ["part", "term"])


def build_references(refs: DataFrame, path: str | None = None, block: int = BLOCK) -> Index:
    """The index of references (reference_id, chunk_id, source_kind, task_id, path, title, symbol, start_line, content).

    A reference is found whole by its path, title, symbol, the last segment of its path, and each beginning of its dotted symbol.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    parts = F.split(low(F.col("symbol")), r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    keys = F.filter(F.concat(F.array(low(F.col("path")), low(F.col("title")), low(F.col("symbol")), low(basename(F.coalesce("path", F.lit(""))))), starts), lambda k: k != "")
    group = F.when(F.col("source_kind") == "TASK", F.col("chunk_id")).otherwise(F.col("reference_id").cast("string"))
    payload = ("reference_id", "chunk_id", "source_kind", "task_id", "path", "title", "symbol", "start_line")
    path = path or shared_folder(refs.sparkSession, "references")
    docs = refs.withColumn("id", F.col("reference_id"))
    return build(docs, path, lexemes(F.col("content")), lexemes(F.concat_ws(" ", "path", "title", "symbol")), payload, F.concat_ws("|", "source_kind", group), keys, block)


def scored(spark: SparkSession, index: Index, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, group, score, row): exact scores of candidates (query_id, id) that match. Only documents that are candidates are read past their ids."""
    ship(spark)
    forward = index.documents(spark).drop("keys")
    q = queries.select("query_id", "raw", "basename", "tokens")
    both = forward.join(candidates.hint("shuffle_hash"), "id").join(q, "query_id")
    # A place and the number of the token there, from 1; a query has fewer than 1024 tokens.
    places = lambda where: F.filter(F.transform(where, lambda x, i: i.cast("long") * 1024 + F.array_position("tokens", x)), lambda v: v % 1024 > 0)
    all_of = lambda where: F.forall("tokens", lambda t: F.array_contains(where, t))
    low = lambda c: F.lower(F.coalesce(F.col(f"row.{c}"), F.lit("")))
    exact = {"symbol": low("symbol") == F.col("raw"), "path": low("path") == F.col("raw"), "basename": basename(low("path")) == F.col("basename"), "title": low("title") == F.col("raw"), "symbol_prefix": F.startswith(low("symbol"), F.concat("raw", F.lit(".")))}
    both = both.where(all_of("c") | all_of("m") | exact["symbol"] | exact["path"] | exact["title"])

    def density(found: Sequence[int], n: int) -> float:
        by = [[int(v) >> 10 for v in found if v % 1024 == t] for t in range(1, n + 1)]
        return cover_density(by) if all(by) else 0.0

    dense = F.pandas_udf(lambda c, m, n: pd.Series([density(x, k) + METADATA_WEIGHT * density(y, k) for x, y, k in zip(c, m, n)], dtype="float64"), "double")
    flags = F.struct(*[cond.alias(name) for name, cond in exact.items()]).alias("exact")
    both = both.select("query_id", "group", "row", flags, places("c").alias("_c"), places("m").alias("_m"), F.size("tokens").alias("_n"))
    both = both.withColumn("_score", dense("_c", "_m", "_n"))
    score = F.col("_score")
    for name in exact:
        score = score + F.when(F.col(f"exact.{name}"), BOOSTS[name]).otherwise(0.0)
    return both.select("query_id", "group", F.round(score, 6).alias("score"), "row")


def search_references(spark: SparkSession, index: Index, queries: DataFrame, top_k: int = 20) -> DataFrame:
    """(query_id, rank, reference_id, source_kind, path, symbol, start_line, score): for each query (query_id, query) its best references, as references.search()
    finds them one query at a time. Queries with a fault have no rows. Query ids do not repeat.

    A match holds every token, so the postings of a query's rarest token name all matches but those found by a whole name; these come from the keys, as does
    whatever can get a boost. Without boosts a document can't score more than its block says times the number of tokens: each occurrence of one token is in
    at most as many least covers as there are tokens. The blocks with the highest bounds are scored first. Their k-th best group gives a threshold, which
    blocks with a lower bound can't reach; the others are scored as well.
    """
    asked = kept(normalised_queries(queries).where("fault IS NULL"), "queries")
    terms = asked.select("query_id", F.size("tokens").alias("t"), F.explode("tokens").alias("term"))
    metadata = postings_of(spark, index, kept(terms.select("term").distinct(), "vocabulary")).select("term", "block", "n", "most")
    df = kept(metadata.groupBy("term").agg(F.sum("n").alias("df")), "df")
    known = terms.join(df, "term").groupBy("query_id", "t").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("known"))
    rarest = kept(known.where("known = t").select("query_id", "t", "term"), "rarest")
    blocks = metadata.join(rarest, "term").select("query_id", "term", "block", (F.col("most") * F.col("t")).alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = kept(blocks.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_BLOCKS).drop("r"), "first")

    def documents_of(chosen: DataFrame) -> DataFrame:
        held = postings_of(spark, index, chosen.select("query_id", "term", F.col("block").alias("_b")))
        return held.where(F.col("block") == F.col("_b")).select("query_id", F.explode("ids").alias("id"))

    keyed = index.documents(spark).select("id", F.explode("keys").alias("key"))
    keyed = keyed.join(asked.select("query_id", F.explode(F.array_distinct(F.array("raw", "basename"))).alias("key")), "key").select("query_id", "id")
    some = kept(scored(spark, index, documents_of(first).unionByName(keyed).distinct(), asked), "scored")
    groups = some.groupBy("query_id", "group").agg(F.max("score").alias("score"))
    kth = groups.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") == top_k)
    least = kept(kth.select("query_id", F.col("score").alias("least")), "least")
    rest = blocks.join(first.select("query_id", "block").withColumn("seen", F.lit(True)), ["query_id", "block"], "left").where("seen IS NULL")
    rest = kept(rest.join(least, "query_id", "left").where("least IS NULL OR bound + 0.000001 >= least"), "rest")
    more = scored(spark, index, documents_of(rest).distinct(), asked)
    every = some.unionByName(more).select("query_id", "group", "score", "row.*")
    best = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), F.asc_nulls_last("task_id"), "reference_id")
    every = every.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_kind", low("path"), low("symbol"), "start_line", "reference_id")
    every = every.withColumn("rank", F.row_number().over(ranks).cast("long")).where(F.col("rank") <= top_k)
    return every.select("query_id", "rank", "reference_id", "source_kind", "path", "symbol", "start_line", "score")


def search_overlap(spark: SparkSession, index: Index | Unindexed, items: DataFrame, top_k: int = 5, first: int = 8) -> DataFrame:
    """(item_id, doc_id, overlap, rank): for each item (item_id, terms; terms distinct) the documents that share most of its terms, at least one.

    A document that shares s of n terms has one of the n - s + 1 rarest. First the `first` rarest terms of an item name candidates, whose overlaps are
    counted exactly; the k-th best, s, tells how many of the rarest terms must be read so that nothing as good is missed, ties included. Commoner terms are never
    joined with their postings.
    """
    asked = kept(items.select("item_id", "terms", F.size("terms").alias("n")), "items")
    each = asked.select("item_id", "n", F.explode("terms").alias("term"))
    df = postings_of(spark, index, kept(each.select("term").distinct(), "vocabulary")).groupBy("term").agg(F.sum(F.col("n")).alias("df"))
    at = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "term"))
    each = kept(each.join(df, "term", "left").withColumn("at", at), "terms")

    def overlaps(chosen: DataFrame) -> DataFrame:
        met = postings_of(spark, index, chosen.select("item_id", "term")).select("item_id", F.explode("ids").alias("id")).distinct()
        both = index.documents(spark).select("id", "c").join(met, "id").join(asked.select("item_id", "terms"), "item_id")
        return both.select("item_id", F.col("id").alias("doc_id"), F.size(F.array_intersect("c", "terms")).cast("long").alias("overlap"))

    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")).cast("long")
    some = kept(overlaps(each.where(F.col("at") <= first)).withColumn("rank", rank).where(F.col("rank") <= top_k), "overlaps")
    least = some.where(F.col("rank") == top_k).select("item_id", F.col("overlap").alias("least"))
    need = each.join(least, "item_id", "left").where((F.col("at") > first) & (F.col("at") <= F.col("n") - F.coalesce("least", F.lit(1)) + 1))
    more = overlaps(kept(need.select("item_id", "term"), "need"))
    every = some.drop("rank").unionByName(more).distinct()
    return every.withColumn("rank", rank).where(F.col("rank") <= top_k)
