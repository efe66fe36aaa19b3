import glob
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import ball_tree, maxscore, sort_means
from brightloom.llm.common import top_per
from brightloom.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, term string, _q long, score long, rank int"
VECS = "vec_id long, embedding array<float>, cluster int, distance long, x int, shard long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored, asked = [], terms(text)
        for i, c in counted:
            m = 75 + (25 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def some_docs(n, seed=1):
    rnd = np.random.default_rng(seed)
    common = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choice(common, rnd.integers(1, 40), p=np.arange(30, 0, -1) / 465)) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


EDGES = [
    (None, "w1 w2"), (None, None), (900, ""), (901, " .,!"), (902, "W1-w2_w3"), (902, "W1-w2_w3"), (903, "ähm Ähm w1"), (904, "w29 " * 30_000 + "rare"), (905, "x" * 3_000_000 + " w5"), (906, None), (907, "w1 w2 😀"),
]


@pytest.mark.parametrize(("k", "postings", "block"), [(1, 50, 1000), (5, 200, 7), (20, 1 << 20, 1 << 16)])
def test_maxscore_is_brute_force(spark, k, postings, block):
    docs = some_docs(300) + EDGES
    items = [(0, "w1 w5 w29"), (1, "w0 w0 w28 w7"), (2, None), (3, "nowhere"), (4, "rare w29 w2"), (5, " ".join(f"w{i}" for i in range(30))), (5, "Ähm"), (None, "w1 😀"), (6, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, t, "t", 1, 1, 1) for i, t in docs], DOCS).repartition(3)
    path = maxscore.build_index(df, shard_postings=postings)
    got = maxscore.search(spark, path, spark.createDataFrame(items, "item_id long, text string"), k, block_terms=block)
    assert rows(got, "item_id", "rank", "doc_id", "score") == ranked(docs, items, k)


def test_maxscore_holds_one_shard_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c") for i in range(12)], "doc_id long, text string").coalesce(1)
    path = maxscore.build_index(docs, shard_postings=6).removeprefix("file:")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    assert sum(m.num_rows for m in files) == 6  # what is written and read together is a row group, of which each is one shard
    assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))


def test_maxscore_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 1, 1, 1)], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert maxscore.ranked_documents(docs.limit(0), items).count() == 0
    assert maxscore.ranked_documents(docs, items.limit(0)).count() == 0
    assert maxscore.ranked_documents(docs, items).count() == 1
    assert maxscore.ranked_documents(spark.createDataFrame([(1, "...", "", 1, 1, 1)], DOCS), items).count() == 0


def test_maxscore_leaves_postings_unread():
    """With a threshold in place, postings of terms that can't decide are probed for candidates only."""
    best = maxscore.Best(1)
    n = 4 * maxscore.RANGE
    every, one = np.arange(n, dtype=np.int32), np.array([5, n - 5], np.int32)
    seen = []

    class Probed(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.asarray(super().__getitem__(at)).size)
            return super().__getitem__(at)

    common = np.full(n, 10, np.int64).view(Probed)
    maxscore.maxscore([(every, common, 1, 10), (one, np.array([900, 950]), 1, 1000)], np.zeros(n, np.int64), np.arange(n), best)
    assert (best.score[0], best.id[0]) == (960, n - 5)
    assert sum(s for s in seen if s == maxscore.RANGE) <= 2 * maxscore.RANGE  # read whole in the first range, before there is a threshold


@given(st.text(alphabet="aZ0 .é \x00-", max_size=60), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_terms_of_pieces(text, at_once):
    old, maxscore.AT_ONCE = maxscore.AT_ONCE, at_once
    try:
        assert [w.decode() for part in maxscore.words_of(text.encode()) for w in part] == terms(text)
    finally:
        maxscore.AT_ONCE = old


def quantised(x, scale):
    return [math.floor(scale * float(c)) for c in x]


def clustered(vectors, k, rounds, seed=3, dims=4, scale=1024):
    kept = [(i, quantised(v, scale)) for i, v in vectors if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [list(v) for _, v in first]
    to = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((to(x, c), j) for j, c in enumerate(centroids))[1]
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    of = [near(v) for _, v in kept]
    d = [to(v, centroids[c]) for (_, v), c in zip(kept, of)]
    own = {j: sum(x for x, c in zip(d, of) if c == j) for j in set(of)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, x, own[c], sum(d), sha[c]) for (i, _), c, x in zip(kept, of, d)), key=str)


CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors_of(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, 1, 1, 1) for i, v in vectors], VECS).repartition(parts)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_sort_means_is_plain_k_means(spark, monkeypatch, small_blocks):
    rnd = np.random.default_rng(5)
    f = lambda v: [float(np.float32(c)) for c in v]
    vectors = [(i, f(rnd.normal(rnd.integers(0, 4), 0.3, 4))) for i in range(200)]
    vectors += [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # copies
    vectors += [(7, [0.25] * 4), (7, [0.25] * 4), (None, [1.0] * 4), (None, [-1.0] * 4), (600, None), (601, []), (602, [1.0] * 3), (603, [1.0, None, 1.0, 1.0]), (604, [math.nan] * 4), (605, [math.inf] * 4)]
    df = vectors_of(spark, vectors)
    got = sort_means.cluster(df, k=8, rounds=4, dims=4)
    assert rows(got, *CLUSTERS) == clustered(vectors, 8, 4)



@pytest.mark.parametrize("n", [0, 1, 5])
def test_sort_means_of_few(spark, n):
    vectors = [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(n)]
    assert rows(sort_means.cluster(vectors_of(spark, vectors, 2), k=8, rounds=3, dims=4), *CLUSTERS) == clustered(vectors, 8, 3)


def test_sort_means_refuses_what_leaves_64_bits(spark):
    with pytest.raises(Exception, match="beyond"):
        sort_means.cluster(vectors_of(spark, [(1, [1e30, 0.0, 0.0, 0.0])]), dims=4).collect()


@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=30), st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6)), min_size=1, max_size=7), st.randoms())
@settings(max_examples=200, deadline=None)
def test_nearest_from_any_previous(points, centroids, rnd):
    x, c = np.array(points, np.int64), np.array(centroids, np.int64)
    of, d = sort_means.nearest(x, np.array([rnd.randrange(len(c)) for _ in x]), c)
    want = [min((((p - q) ** 2).sum(), j) for j, q in enumerate(c)) for p in x]
    assert [(int(a), int(b)) for a, b in zip(d, of)] == [(int(a), int(b)) for a, b in want]


def searched(vectors, every, k, scale=256):
    kept = [(n, i, quantised(v, scale)) for n, (i, v) in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, j) for m, j, x in kept if m != n and len(x) == len(q))
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "wave", "spread"), [(100, 1000, 1.0), (1000, 7, 0.1), (8192, 1 << 16, 0.0)])
def test_ball_trees_are_brute_force(spark, shard, wave, spread):
    rnd = np.random.default_rng(6)
    f = lambda v: [float(np.float32(c)) for c in v]
    vectors = [(i, f(rnd.normal(rnd.integers(-2, 3), spread, 6))) for i in range(700)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(200)]  # copies, many ties
    vectors += [(50, [0.25] * 6), (50, [0.25] * 6), (None, [3.0] * 6), (None, [3.0] * 6), (0, []), (2, []), (100, [1.0] * 2), (3, [2.0] * 2), (150, None), (200, [1.0, None]), (250, [math.nan] * 6), (300, [math.inf] * 6)]
    path = ball_tree.build_trees(vectors_of(spark, vectors), shard=shard)
    got = ball_tree.search(spark, path, every=50, k=5, wave=wave)
    assert rows(got, "query_id", "rank", "vec_id", "score") == searched(vectors, 50, 5)


@pytest.mark.parametrize("vectors", [[], [(1, [1.0])], [(50, [1.0])], [(50, [1.0]), (51, [-2.0])]])
def test_ball_trees_of_few(spark, vectors):
    assert rows(ball_tree.nearest_by_product(vectors_of(spark, vectors, 2)), "query_id", "rank", "vec_id", "score") == searched(vectors, 50, 5)


def test_ball_tree_prunes():
    """Groups apart from each other: of most leaves no vector is scored."""
    rnd = np.random.default_rng(7)
    x = np.concatenate([rnd.normal(0, 1, (512, 8)) + 100 * np.eye(8)[i] for i in range(8)]).astype(np.int64)
    order, nodes = ball_tree.ball_tree(x)
    assert sorted(order) == list(range(len(x)))
    for left, right, start, end, radius, centre in nodes:
        assert np.sqrt(((x[order[start:end]] - centre) ** 2).sum(axis=1)).max() <= radius
        assert left < 0 or (nodes[left][2], nodes[right][3]) == (start, end)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    values = [0, 8, np.arange(len(x)), x[order].astype(np.int32).tobytes(), *zip(*(n[:5] for n in nodes)), np.array([n[5] for n in nodes]).tobytes()]
    schema = to_arrow_schema(ball_tree.TREES)
    tree = ball_tree.Tree(pa.RecordBatch.from_arrays([pa.array([list(v)] if pa.types.is_list(f.type) else [v], f.type) for v, f in zip(values, schema)], schema=schema), 0)
    scored, old = [], ball_tree.products
    ball_tree.products = lambda a, b: scored.append(a.shape[0] * b.shape[0]) or old(a, b)
    try:
        best = ball_tree.Best(np.full(8, -np.inf), 5)
        ball_tree.branch_and_bound(tree, 10 * np.eye(8, dtype=np.int64), np.full(8, -1), np.arange(8), best, np.arange(8))
    finally:
        ball_tree.products = old
    assert sum(scored) < 8 * len(x) / 2
    assert np.array_equal(best.score, np.sort(10 * x[order].T, axis=1)[:, ::-1][:, :5])


def test_top_per_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("s"), "id")
    got = top_per(df, "g", [F.desc("s"), "id"], 4).collect()
    assert len(got) == 12 and all(sorted(r["rank"] for r in got if r["g"] == g) == [1, 2, 3, 4] for g in range(3))


@pytest.mark.parametrize("name", ["op11_maxscore_search", "op12_sort_means", "op13_ball_tree_topk"])
def test_same_as_duckdb(spark, name):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = QUERIES[name](spark, path)
    rel = con.sql(ORACLE_SQL[name])
    assert rows(df, *df.columns) == sorted(rel.select(", ".join(df.columns)).fetchall(), key=str)
