"""Ranked lexical search: an index of postings in shards, searched by MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .common import all_of, ascii_lower, few_at_once, fields, stored, top_per, written

#: A term is a run of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 that are no part of a term become spaces, A-Z become small.
_FOLD = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: Terms that are held as separate objects at once, which bounds memory for very long texts.
AT_ONCE = 1 << 17
#: Documents of a shard that are scored together; the thresholds rise between them.
RANGE = 1024

INDEX = fields(
    "documents long, n_terms long, ids long[], lengths long[], terms string[], df long[], most long[], shortest long[], docs binary, tf binary"
)
FOUND = fields("_q long, doc_id long, score long")


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of its weight in a document, in millionths: rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_factor(n: np.ndarray, documents: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * n * documents) // max(n_terms, 1)


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some at a time."""
    at, step = 0, 8 * AT_ONCE
    while at < len(data):
        part = data[at : at + step].translate(_FOLD)
        if at + step < len(data):
            end = part.rfind(b" ")
            if end < 0:  # one term fills it all
                step *= 2
                continue
            part = part[: end + 1]
        yield part.split()
        at, step = at + len(part), 8 * AT_ONCE


class Shard:
    """Collects documents until it holds enough postings, then gives one row of the index."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.words: list[bytes] = []
        self.of: list[tuple[int, int]] = []
        self.postings = 0

    def add(self, doc_id: object, data: bytes) -> None:
        n = 0
        for words in words_of(data):
            self.words += words
            self.of.append((len(self.ids), len(words)))
            n += len(words)
            if len(self.words) >= AT_ONCE:
                self.compact()
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
        else:
            self.of = [x for x in self.of if x[0] < len(self.ids)]

    def compact(self) -> None:
        if self.words:
            codes = pa.array(self.words, pa.binary()).dictionary_encode()
            doc = np.repeat(*(np.array(x) for x in zip(*self.of)))
            key, tf = np.unique(codes.indices.to_numpy().astype(np.int64) << 32 | doc, return_counts=True)
            self.parts.append((codes.dictionary, key >> 32, key & 0xFFFFFFFF, tf))
            self.postings += key.size
        self.words, self.of = [], []

    def row(self) -> pa.RecordBatch | None:
        self.compact()
        if not self.ids:
            return None
        every = pa.chunked_array([p[0] for p in self.parts]).dictionary_encode().unify_dictionaries()
        names = every.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy()[p[1]] for c, p in zip(every.chunks, self.parts)]).astype(np.int64)
        key, at = np.unique(code << 32 | np.concatenate([p[2] for p in self.parts]), return_inverse=True)  # a long document may be in several parts
        tf = np.zeros(key.size, np.int64)
        np.add.at(tf, at, np.concatenate([p[3] for p in self.parts]))
        term, doc = key >> 32, key & 0xFFFFFFFF
        start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        lengths = np.array(self.lengths, np.int64)
        values = [
            len(self.ids), int(lengths.sum()), self.ids, lengths, names.cast(pa.string()), np.diff(np.append(start, term.size)), np.maximum.reduceat(tf, start),
            np.minimum.reduceat(lengths[doc], start), doc.astype(np.int32).tobytes(), tf.astype(np.int64).tobytes(),
        ]
        schema = to_arrow_schema(INDEX)
        one = lambda v, t: pa.ListArray.from_arrays([0, len(v)], pa.array(v, t.value_type)).cast(t) if pa.types.is_list(t) else pa.array([v], t)
        return pa.RecordBatch.from_arrays([one(v, f.type) for v, f in zip(values, schema)], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = 1 << 19) -> str:
    """Write the index to the shared folder, one row per shard of documents (INDEX), and give its path; no text is moved.

    A shard is a run of documents of one input partition with about `shard_postings` postings; it has its documents' ids and numbers of terms, and by
    term the documents (ascending), occurrences, the largest number of occurrences and the least length, which bound a term's part of any score,
    whatever the corpus' statistics. Every term of every whole text is indexed. Null and empty texts, and texts without a term, are in no shard. Ids
    are longs; null and repeated ids are documents of their own. A very long text is counted some terms at a time. Other columns are ignored. Rows are
    large, so each is a row group: writers, readers and the workers that search hold one at a time, however many a task has.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                shard.add(i.as_py(), text.as_py() or b"")
                if shard.postings + len(shard.words) >= shard_postings:
                    shard.compact()
                if shard.postings >= shard_postings:
                    yield shard.row()
                    shard = Shard()
        if last := shard.row():
            yield last

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, INDEX), "index", group_rows=1)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


class Best:
    """The k best documents of one item so far, and the score that a further one must reach."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.score = self.none = self.id = np.empty(0, np.int64)

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = (np.concatenate(x) for x in ((self.score, score), (self.none, none), (self.id, ids)))
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.id = score[order], none[order], ids[order]
        if self.score.size == self.k:
            self.least = max(1, int(self.score[-1]))


def maxscore(lists: list[tuple[np.ndarray, np.ndarray, int, int]], none: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Put the best documents of a shard into `best`. lists: (documents ascending, saturation of each, weight, upper bound) by term.

    Terms stand by ascending bound. Those whose bounds together stay below the score that is needed are non-essential: a document with none but them
    can't qualify. Candidates come from the essential postings alone; the others are probed from the largest bound down, and only for candidates that
    could still reach the score. A document with just that score stays in, since its id may be smaller.
    """
    lists = sorted(lists, key=lambda x: x[3])
    upto = np.cumsum([x[3] for x in lists])  # upto[j]: what terms 0..j can give together
    edges = np.arange(0, ids.size + RANGE, RANGE)
    cuts = [np.searchsorted(x[0], edges) for x in lists]
    first = 0
    for r in range(edges.size - 1):
        while first < len(lists) and upto[first] < best.least:
            first += 1
        if first == len(lists):
            return
        low = edges[r]
        score = np.zeros(min(RANGE, ids.size - low), np.int64)
        for j in range(first, len(lists)):
            a, b = cuts[j][r], cuts[j][r + 1]
            if a < b:
                score[lists[j][0][a:b] - low] += lists[j][2] * lists[j][1][a:b]
        able = np.flatnonzero(score)
        for j in range(first - 1, -1, -1):
            able = able[score[able] + upto[j] >= best.least]
            a, b = cuts[j][r], cuts[j][r + 1]
            if able.size and a < b:
                there = lists[j][0][a:b]
                at = np.searchsorted(there, able + low)
                at[at == there.size] = 0
                hit = there[at] == able + low
                score[able[hit]] += lists[j][2] * lists[j][1][a:b][at[hit]]
        able = able[score[able] >= best.least]
        if able.size:
            best.add(score[able], none[able + low], ids[able + low])


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", block_terms: int = 1 << 16) -> DataFrame:
    """(item, rank, doc_id, score): each item's k best documents with a score above 0 (all, if fewer), highest first, equal scores by ascending id.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))) with N the documents that have a term and df those that have this one; scores are 64-bit integers.
    Items are rows: repeated item ids are ranked each by itself. Null texts, and texts without a term, have no results. A null document id comes after
    all others of its score; equal rows are ranked by themselves. An empty table of items or of documents gives no rows.

    Items are searched in blocks of about `block_terms` terms. A block, of that size by construction, is sent to all shards; each task carries an item's
    threshold from shard to shard and gives its k best at the end, so what is shuffled does not depend on how many documents match.
    """
    ship(spark)
    index = spark.read.schema(INDEX).parquet(path)
    n, total = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    rows = written(items.select(F.monotonically_increasing_id().alias("_q"), F.col(item_col).alias("_item"), terms_of(F.col(text_col)).alias("_terms")), "items")
    asked = rows.select("_q", F.explode("_terms").alias("term")).groupBy("_q", "term").agg(F.count(F.lit(1)).alias("times"))
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = df.join(written(asked.select("term").distinct(), "vocabulary"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = written(asked.join(df, "term").select("_q", "term", (F.col("times") * weight).alias("w")).where("w > 0"), "asked")
    blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("_q"), F.lit(blocks)))
    shards = few_at_once(spark, 1).read.schema(INDEX).parquet(path)
    found = all_of([spark.read.schema(FOUND).parquet(stored(_searched(shards, asked.where(F.col("block") == b), n, total, k), "found")) for b in range(blocks)])
    best = top_per(found, "_q", [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return best.join(rows.select("_q", "_item"), "_q").select(F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _searched(shards: DataFrame, block: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """(_q, doc_id, score): for each item of a block, the k best documents of each task's shards."""
    asked = block.select("_q", "term", "w").toArrow().sort_by("_q")
    vocabulary = asked.column("term").combine_chunks().cast(pa.string()).dictionary_encode()
    q, start = np.unique(asked.column("_q").to_numpy(), return_index=True)
    sent = shards.sparkSession.sparkContext.broadcast((vocabulary.dictionary, vocabulary.indices.to_numpy(), asked.column("w").to_numpy(), q, np.append(start, asked.num_rows)))
    schema = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, term, weight, items, start = sent.value
        best = [Best(k) for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                one = lambda c: b.column(c)[i].values  # noqa: E731, B023
                length, df = one("lengths").to_numpy(), one("df").to_numpy()
                docs, tf = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("docs", np.int32), ("tf", np.int64)))
                at = pc.index_in(names, value_set=one("terms").cast(pa.string())).to_numpy(zero_copy_only=False)
                there = ~np.isnan(at)
                at = np.where(there, at, 0).astype(np.int64)
                ids = one("ids")
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(0).to_numpy()
                m = length_factor(length, n, total)
                ends = np.cumsum(df)
                bound = saturation(one("most").to_numpy(), length_factor(one("shortest").to_numpy(), n, total))
                held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

                def postings(t: int) -> tuple[np.ndarray, np.ndarray]:
                    if t not in held:  # noqa: B023
                        own = slice(ends[t] - df[t], ends[t])  # noqa: B023
                        held[t] = docs[own], saturation(tf[own], m[docs[own]])  # noqa: B023
                    return held[t]  # noqa: B023

                for x in range(len(items)):
                    mine = [(at[t], w) for t, w in zip(term[start[x] : start[x + 1]], weight[start[x] : start[x + 1]]) if there[t]]
                    if mine:
                        maxscore([(*postings(t), int(w), int(w * bound[t])) for t, w in mine], none, ids, best[x])
        if q_all := [np.full(x.score.size, i) for i, x in zip(items, best)]:
            ids = pa.array(np.concatenate([x.id for x in best]), mask=np.concatenate([x.none for x in best]).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_all), pa.int64()), ids.cast(pa.int64()), pa.array(np.concatenate([x.score for x in best]), pa.int64())], schema=schema)

    return shards.mapInArrow(run, FOUND)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index the documents and rank them for each item: build_index() and search() in one."""
    return search(docs.sparkSession, build_index(docs), items, k)
