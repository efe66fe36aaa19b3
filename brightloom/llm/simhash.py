"""SimHash near-dedup: pigeonhole blocks find close fingerprints, Hamming distance confirms them, components gather them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .common import settle, written

SEED = 42
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
AT_ONCE = 1 << 16


def fingerprint(data: bytes, width: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text, signed. A-Z are lower-cased; words are runs without ASCII white space; shingles count with repeats."""
    words = data.lower().split()  # of bytes: only ASCII letters change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    digest, ones, left = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n
    while left:
        k = min(left, AT_ONCE)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(k), shingles)), np.uint64, k)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(k, 64).sum(axis=0, dtype=np.int64)
        left -= k
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long. Null and empty texts have fingerprint 0."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(fps, pa.int64())], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of which two fingerprints at most `distance` bits apart agree on one at least: all but `distance` of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, blocks - distance)]


def close_forest(v: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the same components as all links between the (distinct) fingerprints v, at most len(v) - 1 of them."""
    near, far, rest = [], [], v
    while rest.size:
        stack, rest = [rest[0]], rest[1:]
        while stack and rest.size:
            x = stack.pop()
            close = np.bitwise_count(rest ^ x) <= distance
            if close.any():
                found, rest = rest[close], rest[~close]
                near.append(np.full(found.size, x))
                far.append(found)
                stack.extend(found)
    return near, far


def close_links(distinct: DataFrame, distance: int = 3, blocks: int = 5, bucket: int = 4096) -> DataFrame:
    """(a, b): links that span the components of all pairs of the distinct fingerprints `fp` at most `distance` bits apart.

    Every fingerprint goes to one bucket per mask. A bucket of up to `bucket` fingerprints is searched whole. A larger one is cut into chunks
    by hash, and each pair of chunks is searched by itself, so no task holds more than two chunks of a bucket and no pair is missed. A search
    gives a spanning forest, never all pairs.
    """
    spark, masks = distinct.sparkSession, block_masks(distance, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)]))
    keys = distinct.select("fp", each.alias("k")).select("fp", "k.*")
    large = written(keys.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "buckets")
    keys = keys.join(large, ["mask", "part"], "left")
    chunks = F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1)).cast("int")
    keys = keys.select("mask", "part", "fp", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("own"))
    pairs = keys.select("mask", "part", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    pairs = pairs.select("mask", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    by = ["mask", "part", "lo", "hi"]
    schema = to_arrow_schema(T.StructType([T.StructField(x, T.LongType()) for x in "ab"]))

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        *key, fp = cols
        fp = fp.view(np.uint64)
        new = np.ones(fp.size, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, fp.size))
        run = np.repeat(np.arange(start.size), size)
        a, b = [], []
        small = size <= 32
        for d in range(1, int(size[small].max(initial=1))):  # buckets of up to 32: all at once, by the distance between rows
            i = np.flatnonzero((run[d:] == run[:-d]) & small[run[d:]])
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            a.append(fp[i])
            b.append(fp[i + d])
        for s, n in zip(start[~small], size[~small]):
            x, y = close_forest(fp[s : s + n], distance)
            a += x
            b += y
        join = lambda z: np.concatenate(z).view(np.int64) if z else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not cols[0].size:
                continue
            last = np.all([k == k[-1] for k in cols[:-1]], axis=0)
            cut = int(last.size - np.argmin(last[::-1])) if not last.all() else 0  # the last bucket may go on in the next batch
            if cut:
                yield linked([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and held[0].size:
            yield linked(held)

    found = pairs.repartition(*by).sortWithinPartitions(*by).select(*by, "fp").mapInArrow(run, "a long, b long")
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node of its component; roots themselves are left out.

    Alternates large-star and small-star steps; each is a grouping with partial aggregation and a join, and the number of links never grows.
    Lineage is cut after each round, in the shared folder.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        hung = e.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), (F.col("v") > F.col("u")).alias("up"))
        hung = hung.where("up").drop("up") if large else hung.drop("up").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())

    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    now = state(links)
    while True:
        links = settle(star(star(links, large=True), large=False))
        before, now = now, state(links)
        if before == now:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, blocks: int = 5, bucket: int = 4096) -> DataFrame:
    """(a, b): ids of rows with close fingerprints, a > b; links that span the groups of near_duplicates(), never all pairs. Ids do not repeat and are not null."""
    fps = settle(fingerprints(docs, id_col, text_col, width))
    distinct = settle(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    equal = fps.join(distinct, "fp").where(F.col(id_col) > F.col("least")).select(F.col(id_col).alias("a"), F.col("least").alias("b"))
    x, y = (distinct.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in "ab")
    close = close_links(distinct, distance, blocks, bucket).join(x, "a").join(y, "b")
    return equal.unionByName(close.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, blocks: int = 5, bucket: int = 4096) -> DataFrame:
    """One row per input row: (id, fingerprint as 16 hex digits, component_id).

    Fingerprints at most `distance` bits apart are linked; component_id is the smallest id that links reach, the row's own included. Equal
    fingerprints are one node, so copies never become pairs. Null and empty texts have fingerprint 0 and are linked like any other. A null id takes
    part in links, is never a component_id if the component has another id, and repeated ids are kept as rows. Texts of any length are read whole, some
    shingles at a time. A bit that exactly half the shingles have is 0. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    fps = settle(fingerprints(docs, id_col, text_col, width))
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(close_links(distinct, distance, blocks, bucket))
    ends = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    own = distinct.join(ends.withColumnRenamed("node", "fp"), "fp", "left")
    joined = own.where("root IS NOT NULL")
    whole = joined.groupBy("root").agg(F.min("least").alias("component"))
    named = joined.join(whole, "root").select("fp", "component").unionByName(own.where("root IS NULL").select("fp", F.col("least").alias("component")))
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
