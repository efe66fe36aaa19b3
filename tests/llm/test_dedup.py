import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brightloom.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hash string, fp long, part int, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 1, "k") for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, "Abc d"), (4, "aBC D"), (5, "äbc"), (6, "Äbc"), (7, "x " * 50_000), (8, "X " * 50_000), (9, " "), (None, "abc d"), (None, "lone"), (None, "lone"), (3, "Abc d")]


@pytest.mark.parametrize("hash128", [exact_dedup.md5_128, lambda t: F.unhex(F.lit("00"))])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_duplicates_compares_bytes(spark, keep, hash128):
    rows = exact_dedup.exact_duplicates(docs(spark, EDGES), keep=keep, hash128=hash128).collect()
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in EDGES:
        groups.setdefault(fold(t), []).append(i)
    want = []
    for i, t in EDGES:
        ids = [x for x in groups[fold(t)] if x is not None]
        best = (min if keep == "min" else max)(ids) if ids else None
        want.append((i, best, len(groups[fold(t)]), i == best))
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows))) == sorted(map(str, want))


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_fingerprint_is_the_definition():
    def plain(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in "\x09\x0a\x0b\x0c\x0d":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for text in ("", " \n", "one", "One TWO", "a b c", "a b c d", "ÄB c\x1cd e f", "w " * 9, " ".join(map(str, range(500)))):
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == plain(text)


def test_masks_meet_every_close_pair():
    for distance, blocks in ((3, 4), (3, 5), (3, 6), (1, 3)):
        masks = simhash.block_masks(distance, blocks)
        for _ in range(200):
            x, y = random.getrandbits(64), 0
            for b in random.sample(range(64), distance):
                y |= 1 << b
            assert any(x & m == (x ^ y) & m for m in masks)


def brute(fps, distance=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array(sorted(fps), np.int64)
    for x in v:
        for y in v[np.bitwise_count((v ^ x).view(np.uint64)) <= distance]:
            a, b = find(int(x)), find(int(y))
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("bucket", [4096, 20])
def test_components_of_dense_and_sparse_fingerprints(spark, bucket):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(63) for _ in range(300)}
    for seed in list(fps)[:5]:  # clusters and chains
        x = seed
        for _ in range(60):
            x ^= 1 << rnd.randrange(63)
            fps.add(x)
            fps.add(seed ^ 1 << rnd.randrange(63) ^ 1 << rnd.randrange(63))
    links = simhash.close_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links.collect())
    found = {f: f for f in fps} | {r.node: r.root for r in simhash.components(links).collect()}
    assert found == brute(fps)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000, 1002: 1000}
    assert simhash.components(links.limit(0)).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (9, base.upper()), (3, base + " more"), (4, "something else"), (None, base), (7, None), (8, ""), (6, "a b"), (6, "a b"), (2, "q " * 200_000)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert {(5, 3), (9, 3), (3, 3), (None, 3), (4, 4), (7, 7), (8, 7), (6, 6), (2, 2)} == got
    assert simhash.near_duplicates(docs(spark, rows)).count() == len(rows)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
