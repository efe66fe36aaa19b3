"""Ranked retrieval: lexical, semantic, hybrid by reciprocal ranks, reranked; and its evaluation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PIECES, cosine_distance, once, search_text, token_estimate, words
from ..session import ship


def query_tokens(query: str, longest: int = 512) -> list[str]:
    """Distinct lower-case pieces of the identifiers in a query, in order; a blank or too long query, or one without a piece, is an error."""
    q = query.strip()
    runs = "".join(c if c.isalnum() else " " for c in q).split()
    if not runs or len(q) > longest:
        raise ValueError("a query is blank, too long or without a word")
    return list(dict.fromkeys(p.casefold() for run in runs for p in re.findall(PIECES, run, re.ASCII) or [run]))


def cover_density(places: Sequence[Sequence[int]], weight: float = 0.1) -> float:
    """Sum over the minimal covers of all terms of weight / (1 + other words inside). places: sorted word positions by term."""
    every = sorted((p, t) for t, ps in enumerate(places) for p in ps)
    last: dict[int, int] = {}
    score, before = 0.0, -1
    for p, t in every:
        last[t] = p
        if len(last) == len(places):
            lo = min(last.values())
            if lo > before:  # minimal: no cover that ends earlier starts here
                score += weight / (1 + p - lo + 1 - len(places))
                before = lo
    return score


def lexical(docs: DataFrame, query: str, top_k: int | None = 20) -> DataFrame:
    """(doc_id, lang, score): documents with every word of the query, among their words and the pieces of their identifiers, by cover density and boosts for exact names.

    One word: each occurrence is its own cover, so the score stays a column expression. More words: positions are scored by a pandas UDF, only for
    documents that hold all words. The order is score, lang, id; top_k None returns every match.
    """
    tokens = query_tokens(query)
    places_of = lambda w, token: F.filter(F.transform(w, lambda x, i: F.when(x == token, i)), lambda p: p.isNotNull())
    places = once(words(search_text(F.coalesce("text", F.lit("")))), lambda w: F.array(*[places_of(w, t) for t in tokens]))
    # Exploding leaves out what lacks a word; a filter would be moved below, and every text cut into words once more for each word asked for.
    full = F.filter(F.array(places), lambda p: F.forall(p, lambda x: F.size(x) > 0))
    held = docs.select("doc_id", "lang", "source", F.explode(full).alias("p"))
    if len(tokens) == 1:
        rank = 0.1 * F.size(F.col("p")[0])
    else:
        ship(docs.sparkSession)

        @F.pandas_udf("double")
        def rank_of(p: pd.Series) -> pd.Series:
            return p.map(cover_density)

        rank = rank_of("p")
    boost = F.when(F.lower("source") == query.strip().lower(), 4.0).otherwise(0.0) + F.when(F.lower("lang") == query.strip().lower(), 1.5).otherwise(0.0)
    scored = held.select("doc_id", "lang", F.round(rank + boost, 6).alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("lang"), F.asc("doc_id")]
    return scored.orderBy(*order).limit(top_k) if top_k else scored


def semantic(vectors: DataFrame, query: Sequence[float], top_k: int | None = 20) -> DataFrame:
    """(vec_id, label, distance): exact cosine distances of all vectors to one query, which is a literal in the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", "label", F.round(cosine_distance(F.col("embedding"), q), 6).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(top_k) if top_k else scored


def best_per(df: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where("_n = 1").drop("_n")


def ranked(top: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ranks 1, 2, ... of a top-k result."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def hybrid(lexical_top: DataFrame, semantic_top: DataFrame, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), top_k: int = 20) -> DataFrame:
    """Reciprocal rank fusion of (id, lexical_rank) and (id, semantic_rank); a side that lacks an id adds 0. An empty semantic side gives lexical order."""
    both = lexical_top.join(semantic_top, "id", "full_outer")
    share = lambda w, c: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    fused = both.select("id", "lexical_rank", "semantic_rank", F.round(share(weights[0], "lexical_rank") + share(weights[1], "semantic_rank"), 9).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(top_k)


def reranked(candidates: DataFrame, texts: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """Candidates (id, hybrid_rank) by the share of the query's words that their text holds; ties keep the hybrid order."""
    q = F.array(*map(F.lit, query_tokens(query)))
    scored = candidates.join(texts.select(F.col("doc_id").alias("id"), F.array_distinct(words(F.col("text"))).alias("w")), "id")
    scored = scored.select("id", "hybrid_rank", F.round(F.size(F.array_intersect("w", q)) / F.size(q), 6).alias("overlap"))
    return scored.orderBy(F.desc("overlap"), "hybrid_rank").limit(top_k)


def containing(docs: DataFrame, items: DataFrame, width: int = 3) -> DataFrame:
    """(item_id, doc_id): the documents of the whole table whose text holds an item's text, sign by sign. Empty and null passages are held by none.

    The words inside a passage (its first and last may be cut off) stand in every text that holds it, so up to `width` of its middle ones find the
    candidates by an equality join on their hash; a passage without a word inside is found by its middle three signs, or all it has. The texts of
    candidates are compared. Documents are cut only into runs of such lengths as some passage asks for.
    """
    cut = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    asked = items.select("item_id", F.col("text").alias("passage"), cut(F.col("text")).alias("w")).where(F.length("text") > 0)
    inside = F.least(F.greatest(F.size("w") - 2, F.lit(0)), F.lit(width))
    signs = F.least(F.length("passage"), F.lit(3))
    asked = asked.withColumn("by", F.when(inside > 0, inside).otherwise(-signs))
    run = F.slice("w", F.expr("size(w) DIV 2 - by DIV 2 + 1"), F.greatest(F.col("by"), F.lit(1)))
    middle = F.substring("passage", F.expr("(length(passage) + by) DIV 2 + 1"), -F.col("by"))
    asked = asked.select("item_id", "passage", "by", F.when(F.col("by") > 0, F.xxhash64("by", run)).otherwise(F.xxhash64("by", F.array(middle))).alias("anchor"))
    text = F.coalesce("text", F.lit(""))

    def runs_of(by: int) -> DataFrame:
        n = abs(by)
        cut_once = docs.select("doc_id", (cut(text) if by > 0 else text).alias("_w"))  # a column of its own: not cut anew for every place
        size = F.size("_w") if by > 0 else F.length("_w")
        hashed = lambda i: F.xxhash64(F.lit(by), F.slice("_w", i, n) if by > 0 else F.array(F.substring("_w", i, F.lit(n))))
        return cut_once.where(size >= n).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), hashed))).alias("anchor"))

    runs = [runs_of(by) for (by,) in asked.select("by").distinct().collect()]  # at most width + 3
    if not runs:
        return docs.select("doc_id").limit(0).select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "doc_id")
    met = reduce(DataFrame.unionByName, runs).join(asked, "anchor").select("item_id", "passage", F.col("doc_id").alias("_d")).distinct()
    return docs.select("doc_id", "text").join(met, F.col("doc_id") == F.col("_d")).where(F.contains("text", F.col("passage"))).select("item_id", "doc_id").distinct()


def evaluation(results: DataFrame, relevant: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """One row over all queries asked: recall@k and @1, mean reciprocal rank, precision, and critical queries of which nothing relevant came back.

    asked: (item_id, critical). relevant: (item_id, doc_id) from the whole table; a query of which nothing relevant is found, or exists, is a miss.
    """
    first = results.join(relevant, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("first"))
    n = results.agg(F.count(F.lit(1)).alias("returned"))
    hit = F.coalesce(F.col("first") <= k, F.lit(False))
    m = asked.join(first, "item_id", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(hit).alias("hits"), F.count_if(F.col("first") == 1).alias("at_1"), F.sum(1 / F.col("first")).alias("rr"),
        F.count_if(F.col("critical") & ~hit).alias("critical_misses"),
    ).crossJoin(F.broadcast(n))  # one row each
    share = lambda a, b: F.round(F.coalesce(F.col(a), F.lit(0)) / F.nullif(F.col(b), F.lit(0)), 4)
    shares = {"recall": ("hits", "queries"), "recall_at_1": ("at_1", "queries"), "mrr": ("rr", "queries"), "precision": ("hits", "returned")}
    return m.select("queries", *[share(*of).alias(name) for name, of in shares.items()], "critical_misses")


def adaptive_budget(items: DataFrame, group: str, order: str, text: str, required: str, budget: Column, overhead: int = 64, floor: int = 2048, ceiling: int = 6144) -> DataFrame:
    """(group, order, tokens, budget, kept, error): required items always stay; optional ones are dropped from the tail until the rest fits.

    `budget` is a group's own, held to floor..ceiling. A group whose required items alone are over it keeps nothing and says so. Totals of required
    items and running sums of optional ones are windows over a group's items.
    """
    must = F.coalesce(F.col(required), F.lit(False))
    own = Window.partitionBy(group)
    n = items.select(group, order, must.alias("_must"), token_estimate(F.col(text)).alias("tokens"), F.least(F.greatest(budget, F.lit(floor)), F.lit(ceiling)).cast("long").alias("budget"))
    n = n.withColumn("_base", F.sum(F.when(F.col("_must"), F.col("tokens")).otherwise(0)).over(own) + overhead)
    upto = own.orderBy("_must", order).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("_used", F.sum(F.when(F.col("_must"), 0).otherwise(F.col("tokens"))).over(upto))
    over = F.col("_base") > F.col("budget")
    kept = ~over & (F.col("_must") | (F.col("_base") + F.col("_used") <= F.col("budget")))
    return n.select(group, order, "tokens", "budget", kept.alias("kept"), F.when(over, "required_context_exceeds_token_budget").alias("error"))


def within_budget(items: DataFrame, group: str, order: str, text: str, budget: int, overhead: int = 64) -> DataFrame:
    """Items of each group that fit a token budget: optional ones are dropped from the tail, so the longest prefix that fits stays."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.octet_length(text) + 1).over(upto) - 1
    n = items.select(group, order, token_estimate(F.col(text)).alias("tokens"), size.alias("_bytes"))
    used = F.expr(f"(_bytes + 3) DIV 4 + {overhead}")
    return n.select(group, order, "tokens", used.alias("used"), (used <= budget).alias("kept"))


def cut_to_characters(items: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """Items of each group up to `most` characters in all; the last one is cut."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = items.select(group, order, F.col(text).alias("_t"), before.alias("_before")).where(F.col("_before") < most)
    return n.select(group, order, F.left("_t", (F.lit(most) - F.col("_before")).cast("int")).alias("excerpt"))


def rerank_document(kind: Column, path: Column, title: Column, symbol: Column, snippet: Column, most: int = 4000) -> Column:
    """What a reranker sees of a candidate, as JSON with its keys in this order; the snippet goes where the whole would be too long, null if even that is."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    made = lambda text: F.to_json(F.struct(kind.alias("source_kind"), blank(path).alias("path"), blank(title).alias("title"), blank(symbol).alias("qualified_symbol"), text.alias("snippet")))
    full, bare = made(F.left(blank(snippet), F.lit(most))), made(F.lit(""))
    return F.when(F.length(full) <= most, full).when(F.length(bare) <= most, bare)


def concept_vector(text: Column, concepts: Sequence[Sequence[str]]) -> Column:
    """An offline embedding: how many words of each concept a text has, scaled to length 1; all zero without any."""
    counts = lambda w: F.array(*[F.size(F.array_intersect(w, F.array(*map(F.lit, c)))).cast("double") for c in concepts])
    norm_of = lambda n: F.sqrt(F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda n, norm: F.transform(n, lambda x: F.when(norm > 0, F.round(x / F.nullif(norm, F.lit(0.0)), 8)).otherwise(0.0))
    return once(once(F.array_distinct(words(text)), counts), lambda n: once(norm_of(n), lambda norm: scaled(n, norm)))


def overlap_score(query: Column, document: Column) -> Column:
    """An offline rerank score: shared words, and a fraction below 1/1000 from a hash of both, so that equal overlaps have one order everywhere."""
    tie = F.conv(F.left(F.sha2(F.concat_ws("\u0000", query, document), 256), F.lit(8)), 16, 10).cast("double") / 2**32
    return F.size(F.array_intersect(F.array_distinct(words(query)), F.array_distinct(words(document)))) + tie / 1000
