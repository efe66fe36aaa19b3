"""SimHash near-dedup carried on to a similarity of shingles: what SimHash blocks link is confirmed first, MinHash bands find what they cannot reach.

Texts that share 0.8 of their five-word shingles have SimHashes 3 to 14 bits apart, beyond what pigeonhole blocks of 64 bits can join at scale. So the
links of simhash.near_links() are a start, which gathers the closest copies cheaply; bands bring the other candidates, and the exact share of shingles
decides on each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from .common import settle, written
from .simhash import AT_ONCE, SEED, components

#: Rows of a MinHash band.
ROWS = 4


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles; A-Z are lower-cased, words are runs without ASCII white space. Fewer than `width` words are one shingle."""
    words = data.lower().split()
    n = max(len(words) - width + 1, 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n))


def similarity_of(x: np.ndarray, y: np.ndarray) -> float:
    """Shared shingles over all shingles of two sorted sets."""
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / (x.size + y.size - both)


def bands_for(similarity: float, chance: float) -> int:
    """Bands of ROWS rows of which a pair with this similarity shares one with at least this chance."""
    p = similarity**ROWS
    return 1 if p >= 1 else math.ceil(math.log(1 - chance) / math.log(1 - p))


def band_keys(shingles: np.ndarray, bands: int) -> list[int]:
    """A signed 64-bit key per band, of the least shingles in ROWS random orders."""
    rnd = np.random.default_rng(SEED)
    by = rnd.integers(0, 1 << 63, bands * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rnd.integers(0, 1 << 63, bands * ROWS, np.uint64)
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max, np.uint64)
    step = AT_ONCE // ROWS // bands
    for at in range(0, shingles.size, step):
        np.minimum(least, (shingles[at : at + step, None] * by + plus).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(bands)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def memberships(docs: DataFrame, row_col: str, text_col: str, width: int, bands: int) -> DataFrame:
    """(row, band): the band keys of each row's whole text."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(shingle_set(t.as_py() or b"", width), bands) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(keys, arrow.field(1).type)], schema=arrow)

    return docs.select(F.col(row_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema).select("row", F.explode("bands").alias("band"))


def confirmed(pairs: DataFrame, docs: DataFrame, row_col: str, text_col: str, width: int, similarity: float, share: int = 1024) -> DataFrame:
    """The pairs (a, b) of rows whose texts share at least `similarity` of their shingles. Only texts that occur in a pair are moved to it.

    A row b of more than `share` pairs gets a copy of its text for each so many of them, and its pairs are dealt over the copies.
    """
    ship(docs.sparkSession)
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("_end")).distinct(), "ends")
    texts = docs.select(F.col(row_col).alias("_row"), F.col(text_col).cast("binary").alias("_text"))
    texts = written(texts.join(ends, F.col("_row") == F.col("_end"), "left_semi"), "texts")
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("copies"))
    often = written(often.where("copies > 1"), "often")
    copies = F.coalesce("copies", F.lit(1))
    pairs = pairs.join(often, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), copies).alias("copy"))
    schema = to_arrow_schema(T.StructType([T.StructField(x, T.LongType()) for x in "ab"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda data: shingle_set(data, width))
        for batch in batches:
            x, y = ([c.as_py() or b"" for c in batch.column(i)] for i in (2, 3))
            close = pa.array([similarity_of(shingle_set(s, width), known(t)) >= similarity for s, t in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(close) for i in (0, 1)], schema=schema)

    left = texts.select(F.col("_row").alias("a"), F.col("_text").alias("x"))
    right = texts.select(F.col("_row").alias("b"), F.col("_text").alias("y")).join(often, "b", "left")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)).alias("copy"))
    return pairs.join(left, "a").join(right, ["b", "copy"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, rows: DataFrame, row_col: str, text_col: str, width: int) -> DataFrame:
    """(row, shingles as bytes) of the rows listed in `rows`; only their texts are read whole and none is moved."""
    texts = docs.select(F.col(row_col).alias("_row"), F.col(text_col).cast("binary").alias("_text")).join(rows.select(F.col("row").alias("_end")), F.col("_row") == F.col("_end"), "left_semi")
    schema = to_arrow_schema(T.StructType([T.StructField("row", T.LongType()), T.StructField("shingles", T.BinaryType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py() or b"", width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return texts.select("_row", "_text").mapInArrow(run, "row long, shingles binary")


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two sets share: products of the tables of which set has which shingle, some shingles at a time."""
    values = np.concatenate(sets)
    which = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    order = np.argsort(values, kind="stable")
    values, which = values[order], which[order]
    new = np.append(True, values[1:] != values[:-1])
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1  # a shingle of one set is shared with none
    which, number = which[often], np.cumsum((new & often)[often]) - 1
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(number[-1]) + 1 if number.size else 0, columns):
        part = slice(*np.searchsorted(number, [at, at + columns]))
        has = np.zeros((len(sets), columns), np.float32)
        has[which[part], number[part] - at] = 1
        both += has @ has.T
    return both


def joining_links(rows: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between rows of different components that span what all similar pairs join; fewer than there are components."""
    size = np.array([s.size for s in sets])
    both = shared_counts(sets)
    near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    _, comp = np.unique(comps, return_inverse=True)
    found = []
    for i in range(rows.size):
        for j in np.flatnonzero(near[i] & (comp != comp[i])):
            if comp[j] != comp[i]:
                found.append((int(rows[i]), int(rows[j])))
                comp[comp == comp[j]] = comp[i]
    return found


def bucket_links(members: DataFrame, sets: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """(a, b): links between similar rows of a bucket that are in different components. members: (band, row, comp); sets: (row, shingles).

    A bucket of up to `chunk` rows is searched whole. A larger one is cut: a component of its own over that size into chunks, and all other rows into
    chunks by hash; each two chunks that are not of one such component are searched together, so a task holds two chunks and no pair is missed.
    """
    sizes = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("_n"))
    large = written(sizes.where(F.col("_n") > chunk).select("band", "comp", F.col("comp").alias("own")), "large")
    rows = members.join(large, ["band", "comp"], "left")
    layout = rows.groupBy("band", "own").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    layout = written(layout.groupBy("band").agg(F.collect_list(F.struct("own", "chunks")).alias("layout")), "layout")  # rows / chunk entries
    mine = F.filter("layout", lambda g: g["own"].eqNullSafe(F.col("own")))[0]["chunks"]
    rows = rows.join(layout, "band").withColumn("k", F.pmod(F.xxhash64("row"), mine).cast("int"))
    each = F.flatten(F.transform("layout", lambda g: F.transform(F.sequence(F.lit(0), g["chunks"] - 1), lambda k: F.struct(g["own"].alias("own"), k.alias("k")))))
    others = F.filter(each, lambda o: F.col("own").isNull() | ~o["own"].eqNullSafe(F.col("own")))
    me = F.struct("own", "k")
    rows = rows.select("band", "row", "comp", me.alias("me"), F.explode(others).alias("other"))
    rows = rows.select("band", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"), "row", "comp")
    key = F.xxhash64("band", "lo.own", "lo.k", "hi.own", "hi.k").alias("key")  # colliding keys only search more together
    by = rows.select(key, "row", "comp").join(sets, "row").repartition("key").sortWithinPartitions("key").select("key", "row", "comp", "shingles")
    schema = to_arrow_schema(T.StructType([T.StructField(x, T.LongType()) for x in "ab"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list] | None = None

        def linked() -> pa.RecordBatch:
            row, comp, data = zip(*held[1])
            found = joining_links(np.array(row), np.array(comp), [np.frombuffer(d, np.uint64) for d in data], similarity) if len(set(comp)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

        for b in batches:
            for key, row, comp, data in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0] != key:
                    yield linked()
                    held = None
                held = held or (key, [])
                held[1].append((row, comp, data))
        if held:
            yield linked()

    return by.mapInArrow(run, "a long, b long").distinct()


def near_copies(
    docs: DataFrame, row_col: str, text_col: str = "text", width: int = 5, similarity: float = 0.8, chance: float = 0.9999, chunk: int = 512, first: DataFrame | None = None,
) -> DataFrame:
    """(node, root): for each row with near copies, the smallest row of its component; roots themselves are left out. `row_col` is a long without repeats.

    Two rows are linked when they share at least `similarity` of their distinct `width`-word shingles. A pair at the limit meets in a band with
    `chance`, a closer one more surely; what meets is checked exactly, so no pair below the limit is linked. `first`: links (a, b) that are checked before
    any others, which decides nothing but the order. Null texts count as empty; empty texts, and equal texts of any kind, are near copies of each other.
    Texts of any length are read whole. A pair at the limit is linked. An empty table gives no rows. Other columns are ignored, whatever their names.

    Rows that meet and are not yet in one component are all tested. First each row against one other, the smallest row of most of its buckets: a large
    group of near copies becomes few components with a link each. Then the buckets that still have several components are searched in chunks of `chunk` rows, which
    gives links between components only, never all pairs.
    """
    bands = bands_for(similarity, chance)
    keys = settle(memberships(docs, row_col, text_col, width, bands))
    met = written(keys.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("pivot")).where("_n > 1").select("band", "pivot"), "met")
    members = written(keys.join(met, "band").select("band", "row", "pivot"), "members")
    often = members.where("row <> pivot").groupBy("row", "pivot").agg(F.count(F.lit(1)).alias("n"))
    star = often.groupBy("row").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b")).select(F.col("row").alias("a"), "b")
    star = star if first is None else star.unionByName(first.select("a", "b"))
    links = written(confirmed(written(star.distinct(), "pairs"), docs, row_col, text_col, width, similarity), "links")
    roots = written(components(links), "roots")
    left = members.join(roots, F.col("row") == F.col("node"), "left").select("band", "row", F.coalesce("root", "row").alias("comp"))
    open_ = written(left.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band"), "open")
    left = written(left.join(open_, "band"), "left")
    sets = written(shingle_sets(docs, written(left.select("row").distinct(), "ends"), row_col, text_col, width), "sets")
    more = written(bucket_links(left, sets, similarity, chunk), "more")
    return components(links.unionByName(more))
