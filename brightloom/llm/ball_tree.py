"""Exact search by inner product: ball trees over shards of vectors, branch and bound with the best scores known so far."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .common import all_of, few_at_once, fields, stored, top_per

#: Vectors of a leaf; queries that go down a tree together.
LEAF, TOGETHER = 64, 2048

TREES = fields("shard long, dims int, ids long[], vectors binary, left int[], right int[], start int[], end int[], radius double[], centre binary")
ASKED = fields("shard long, place int, vec_id long, dims int, vector binary, least double")
FOUND = fields("shard long, place int, found_id long, score long")


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The vectors' order and the nodes (left, right, start, end, radius, centre) over it, root first; leaves have -1 as children.

    A node is cut in half along the line between two far points, so that equal vectors in any number give balanced halves.
    """
    order, nodes = np.arange(len(x)), []

    def node(start: int, end: int) -> int:
        own = x[order[start:end]].astype(np.float64)
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        number = len(nodes)
        nodes.append((-1, -1, start, end, float(away.max()) * (1 + 1e-9), centre))
        if end - start > LEAF:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own @ (b - a), half)]
            nodes[number] = (node(start, start + half), node(start + half, end), *nodes[number][2:])
        return number

    node(0, len(x))
    return order, nodes


def build_trees(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard: int = 8192) -> str:
    """Write a ball tree for each shard of up to `shard` vectors to the shared folder, one row per shard (TREES), and give the path; nothing is shuffled.

    Components become integers floor(scale * component). Vectors that are null or hold a null or non-finite component are left out; those of other
    lengths are in shards of their own. Null and repeated ids, and equal vectors, are vectors of their own. A component beyond 31 bits fails the job.
    """
    ship(vectors.sparkSession)
    v, schema = F.col(vector_col), to_arrow_schema(TREES)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        size: dict[int, int] = {}

        def out(dims: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids = pa.concat_arrays([i for i, _ in held[dims]])
            x = np.concatenate([y for _, y in held.pop(dims)])
            size.pop(dims)
            for at in range(0, len(x), shard):
                some = x[at : at + shard]
                order, nodes = ball_tree(some)
                made += 1
                values = [part << 33 | made, dims, ids.slice(at, shard).take(pa.array(order)), some[order].astype(np.int32).tobytes(), *zip(*(n[:5] for n in nodes)), np.array([n[5] for n in nodes]).tobytes()]
                one = lambda value, t: pa.ListArray.from_arrays([0, len(value)], value if isinstance(value, pa.Array) else pa.array(value, t.value_type)).cast(t) if pa.types.is_list(t) else pa.array([value], t)
                yield pa.RecordBatch.from_arrays([one(value, f.type) for value, f in zip(values, schema)], schema=schema)

        for b in batches:
            length = np.diff(b.column(1).offsets.to_numpy())
            flat = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if flat.size and np.abs(flat).max() >= 1 << 31:
                raise ValueError("a component is beyond 31 bits after scaling")
            start = np.cumsum(length) - length
            for dims in map(int, np.unique(length)):
                rows = np.flatnonzero(length == dims)
                x = flat[start[rows][:, None] + np.arange(dims)].astype(np.int64)
                held.setdefault(dims, []).append((b.column(0).take(pa.array(rows)), x))
                size[dims] = size.get(dims, 0) + len(rows)
                if size[dims] >= shard:
                    yield from out(dims)
            if sum(size.values()) >= 4 * shard:  # many lengths
                for dims in list(held):
                    yield from out(dims)
        for dims in list(held):
            yield from out(dims)

    return stored(vectors.where(finite).select(F.col(id_col).cast("long"), v).mapInArrow(run, TREES), "trees")


class Best:
    """For each of some queries its k best so far, and the least score that a further one must have."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.least = k, least.copy()
        self.score, self.none, self.id = np.full((len(least), k), -np.inf), np.full((len(least), k), 2), np.zeros((len(least), k), np.int64)

    def add(self, rows: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """score: by row and candidate."""
        hit = (score >= self.least[rows, None]).any(axis=1)
        rows, score = rows[hit], score[hit]
        if rows.size:
            wide = lambda own, new: np.concatenate([own[rows], np.broadcast_to(new, (rows.size, score.shape[1]))], axis=1)
            score, none, ids = wide(self.score, score), wide(self.none, none), wide(self.id, ids)
            best = np.lexsort((ids, none, -score), axis=1)[:, : self.k]
            self.score[rows], self.none[rows], self.id[rows] = (np.take_along_axis(a, best, 1) for a in (score, none, ids))
            self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])


class Tree:
    """A row of TREES as arrays."""

    def __init__(self, b: pa.RecordBatch, i: int) -> None:
        get = lambda c: b.column(c)[i]
        self.shard, self.dims = get("shard").as_py(), get("dims").as_py()
        self.ids_as_read = get("ids").values
        self.ids, self.none = self.ids_as_read.fill_null(0).to_numpy(), self.ids_as_read.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.x = np.frombuffer(get("vectors").as_buffer(), np.int32).reshape(len(self.ids), self.dims)
        self.left, self.right, self.start, self.end, self.radius = (get(c).values.to_numpy() for c in ("left", "right", "start", "end", "radius"))
        self.centre = np.frombuffer(get("centre").as_buffer(), np.float64).reshape(len(self.left), self.dims)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products as doubles; sums of up to 53 bits are exact in any order. What is larger is an error rather than a wrong order."""
    if x.size and y.size and x.shape[1] * float(np.abs(x).max()) * float(np.abs(y).max()) >= 2**53:
        raise ValueError("scores leave 53 bits")
    return x.astype(np.float64) @ y.astype(np.float64).T


def branch_and_bound(tree: Tree, q: np.ndarray, shard: np.ndarray, place: np.ndarray, best: Best, rows: np.ndarray) -> None:
    """Search a tree for the queries q, which are `rows` of `best`; their own rows (shard, place) are no candidates.

    A node is opened only for the queries whose bound (product with the centre, plus the query's length times the radius) reaches their least score;
    the node with the largest bound comes first, and scores found rise the least scores for all that follow.
    """
    y = q.astype(np.float64)
    length = np.sqrt((y**2).sum(axis=1))
    far = np.sqrt((tree.centre**2).sum(axis=1))

    def bound(n: int, at: np.ndarray) -> np.ndarray:
        return y[at] @ tree.centre[n] + length[at] * (tree.radius[n] + 1e-9 * (far[n] + tree.radius[n])) + 1e-6  # with room for rounding

    def entry(n: int, at: np.ndarray) -> None:
        b = bound(n, at)
        able = b >= best.least[rows[at]]
        if able.any():
            heapq.heappush(waiting, (-b[able].max(), n, at[able], b[able]))

    waiting: list[tuple] = []
    entry(0, np.arange(len(q)))
    while waiting:
        _, n, at, b = heapq.heappop(waiting)
        at = at[b >= best.least[rows[at]]]
        if not at.size:
            continue
        if tree.left[n] >= 0:
            entry(tree.left[n], at)
            entry(tree.right[n], at)
            continue
        own = slice(tree.start[n], tree.end[n])
        score = products(q[at], tree.x[own])
        mine = (shard[at] == tree.shard)[:, None] & (place[at][:, None] == np.arange(own.start, own.stop))
        score[mine] = -np.inf
        best.add(rows[at], score, tree.none[own], tree.ids[own])


def search(spark: SparkSession, path: str, every: int = 50, k: int = 5, wave: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k others with the highest inner products (all, if fewer).

    Equal scores go by ascending id, a null id last. Every row but the query's own is a candidate, also one that repeats its id; rows of null ids are
    candidates but no queries. Only vectors of the query's length are compared. An empty table, or one without a query, gives no rows. Scores are
    exact; such as leave 53 bits fail the job.

    First each query searches its own shard, which gives a score that its k-th result reaches at least. With that bound, queries go to all shards in
    waves of about `wave` queries, whose size is bounded by construction. A task raises the bounds from shard to shard and gives k results a query.
    """
    ship(spark)
    trees = few_at_once(spark, 8).read.schema(TREES).parquet(path)
    schema = to_arrow_schema(ASKED)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = Tree(b, i)
                at = np.flatnonzero((t.ids % every == 0) & (t.none == 0))
                best = Best(np.full(at.size, -np.inf), k)
                for some in np.split(np.arange(at.size), range(TOGETHER, at.size, TOGETHER)):
                    branch_and_bound(t, t.x[at[some]], np.full(some.size, t.shard), at[some], best, some)
                data = [t.x[p].tobytes() for p in at]
                cols = [np.full(at.size, t.shard), at.astype(np.int32), t.ids[at], np.full(at.size, t.dims, np.int32), pa.array(data, pa.binary()), best.least]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    asked = spark.read.schema(ASKED).parquet(stored(trees.mapInArrow(own, ASKED), "asked"))
    waves = max(1, -(-asked.count() // wave))
    of = F.pmod(F.xxhash64("shard", "place"), F.lit(waves))
    found = all_of([spark.read.schema(FOUND).parquet(stored(_searched(trees, asked.where(of == w), k), "found")) for w in range(waves)])
    query = found.withColumn("query", F.struct("shard", "place"))
    best = top_per(query, "query", [F.desc("score"), F.asc_nulls_last("found_id")], k).select("shard", "place", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("vec_id"), "score")
    return best.join(asked.select("shard", "place", F.col("vec_id").alias("query_id")), ["shard", "place"]).select("query_id", "rank", "vec_id", "score")


def _searched(trees: DataFrame, wave: DataFrame, k: int) -> DataFrame:
    """(shard, place, found_id, score): for each query of a wave, the k best of each task's shards that reach its bound."""
    asked = wave.toArrow().combine_chunks()
    plain = {c: asked.column(c).to_numpy() for c in ("shard", "place", "least")}
    lengths = asked.column("dims").to_numpy()
    vectors = {}
    for d in map(int, np.unique(lengths)):
        rows = np.flatnonzero(lengths == d)
        vectors[d] = rows, np.frombuffer(b"".join(asked.column("vector").take(pa.array(rows)).to_pylist()), np.int32).reshape(len(rows), d)
    sent = trees.sparkSession.sparkContext.broadcast((plain, vectors))
    schema = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, vectors = sent.value
        shard, place = plain["shard"], plain["place"]
        best = Best(plain["least"], k)
        for b in batches:
            for i in range(b.num_rows):
                t = Tree(b, i)
                rows, q = vectors.get(t.dims, (np.empty(0, np.int64), np.empty((0, t.dims), np.int32)))
                for at in range(0, len(rows), TOGETHER):
                    some = rows[at : at + TOGETHER]
                    branch_and_bound(t, q[at : at + TOGETHER], shard[some], place[some], best, some)
        row, n = np.nonzero(np.isfinite(best.score))
        ids = pa.array(best.id[row, n], mask=best.none[row, n] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(place[row]), ids, pa.array(best.score[row, n].astype(np.int64))], schema=schema)

    return trees.mapInArrow(run, FOUND)


def nearest_by_product(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Build the trees and search them: build_trees() and search() in one."""
    return search(vectors.sparkSession, build_trees(vectors, id_col, vector_col, scale), every, k)
