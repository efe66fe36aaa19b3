"""Centroid clustering by sort-means: exact rounds over integer vectors that scan only centroids near the previous one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .common import few_at_once, fields, shared_dir, stored

#: Vectors of a block, and the largest integer component: with it, a distance of 64 components stays within 64 bits.
BLOCK, LARGEST = 4096, 1 << 27

BLOCKS = fields("block long, ids long[], vectors binary")
MOVED = fields("block long, assigned binary, counts long[], sums long[]")
NEAREST = fields("vec_id long, cluster int, distance long")


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): vectors of exactly `dims` finite components as integers floor(scale * component)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fits = lambda x: F.when(F.abs(x) <= LARGEST, x.cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("int"))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: fits(F.floor(x.cast("double") * scale))).alias("x"))


def blocks_of(quantised: DataFrame, dims: int) -> DataFrame:
    """Vectors as rows of up to BLOCK vectors each."""
    schema = to_arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            nonlocal n
            x = rows.column(1).combine_chunks().values.to_numpy().astype(np.int32)
            ids = rows.column(0).combine_chunks()
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([part << 33 | n]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([x.tobytes()])], schema=schema)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                rows = pa.Table.from_batches(held)
                while rows.num_rows >= BLOCK:
                    yield out(rows.slice(0, BLOCK).combine_chunks())
                    rows = rows.slice(BLOCK)
                held = rows.combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            yield out(pa.Table.from_batches(held))

    return quantised.mapInArrow(run, BLOCKS)


def nearest(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector: its nearest centroid, ties to the smaller number.

    For each centroid the others stand in the order of their distance from it. A vector scans them from its previous centroid's list and stops where
    they are strictly further from that centroid than twice the vector's own distance from it: by the triangle inequality none there is nearer.
    """
    to = lambda v, c: ((v - c) ** 2).sum(axis=-1)
    apart = np.stack([to(centroids, c) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    cluster, least = previous.astype(np.int64), np.empty(len(x), np.int64)
    for p in np.unique(previous):
        rows = np.flatnonzero(previous == p)
        v = x[rows]
        own = to(v, centroids[p])
        best, of = own.copy(), np.full(len(rows), p)
        for c in order[p]:
            if c == p:
                continue
            scan = np.flatnonzero((apart[p, c] + 3) // 4 <= own)  # apart <= 4 * own, squares: within twice the distance
            if not scan.size:
                break
            d = to(v[scan], centroids[c])
            closer = (d < best[scan]) | (d == best[scan]) & (c < of[scan])
            best[scan[closer]], of[scan[closer]] = d[closer], c
        cluster[rows], least[rows] = of, best
    return cluster, least


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(block, ids, vectors, previous clusters) of each row."""
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b.column("vectors")[i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
            before = b.column("assigned")[i]
            yield b.column("block")[i], b.column("ids")[i].values, x, np.frombuffer(before.as_buffer(), np.int32) if before.is_valid else np.zeros(len(x), np.int32)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): exact k-means over integers floor(scale * component).

    Centroids start as the k vectors with the smallest lower-case hex SHA-256 of `seed:id`. Each round assigns every vector to its nearest centroid
    (squared Euclidean distance, ties to the smaller number), then replaces each centroid that has vectors by the floor of their mean, component by
    component; then vectors are assigned once more. Vectors that are null, of another length, or with a null or non-finite component are left out. A null
    id comes last in the choice of the first centroids; vectors of equal ids, or of none, are chosen by their components. Repeated rows count by
    themselves. With fewer than k vectors there are as many centroids. An empty table gives no rows. Other columns are ignored. A component beyond
    LARGEST after scaling fails the job, as distances would leave 64 bits.

    Vectors are written once, in blocks, as a table bucketed by block. Each round reads it with the clusters of the round before, a table with the same
    buckets, so neither is shuffled; it writes the new clusters and each block's sums, of which only k * dims totals come to the driver.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, id_col, vector_col, dims, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(F.asc_nulls_last(hashed), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in first], np.int64)
    session, buckets, name = few_at_once(spark, 8), max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"sort_means_{uuid.uuid4().hex}"

    def bucketed(df: DataFrame, what: str) -> DataFrame:
        table = f"{name}_{what}"
        df.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
        return session.table(table)

    every = bucketed(blocks_of(rows, dims).repartition(buckets, "block"), "blocks")
    before = every.withColumn("assigned", F.lit(None).cast("binary"))
    for r in range(rounds):
        moved = bucketed(before.mapInArrow(_moving(centroids, dims), MOVED), f"round{r}")
        totals = moved.select(F.posexplode(F.concat("counts", "sums")).alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        total = dict(totals.collect())
        for c in range(len(centroids)):
            if count := int(total[c]):
                centroids[c] = [int(total[len(centroids) + c * dims + i]) // count for i in range(dims)]
        before = every.join(moved.select("block", "assigned"), "block")
    last = spark.read.schema(NEAREST).parquet(stored(before.mapInArrow(_assigning(centroids, dims), NEAREST), "nearest"))
    inertia = dict(last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("n")).collect())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(c, inertia[c], sum(inertia.values()), digest(centroids[c].tolist())) for c in inertia]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moving(centroids: np.ndarray, dims: int):
    """A round: the clusters of each block's vectors, and by cluster their number and sums."""
    schema, k, now = to_arrow_schema(MOVED), len(centroids), centroids.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, x, before in _blocks(batches, dims):
            cluster, _ = nearest(x, before, now)
            sums = np.zeros((k, dims), np.int64)
            for c in np.unique(cluster):
                sums[c] = x[cluster == c].sum(axis=0)
            counts = np.bincount(cluster, minlength=k)
            yield pa.RecordBatch.from_pylist([{"block": block.as_py(), "assigned": cluster.astype(np.int32).tobytes(), "counts": counts, "sums": sums.ravel()}], schema=schema)

    return run


def _assigning(centroids: np.ndarray, dims: int):
    schema, now = to_arrow_schema(NEAREST), centroids.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, before in _blocks(batches, dims):
            cluster, least = nearest(x, before, now)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(least)], schema=schema)

    return run
