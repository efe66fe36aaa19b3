import itertools
import random

import pytest
from pyspark.sql import functions as F

from brightloom.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, size long, rank int, turn long, slot string, part int, one long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, 9, 9, "x", 9, 9) for i, t, s in rows], SCHEMA)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > limit * sizes[s]]
        for s in over or open_:
            target[s] = min(level * w[s], limit * sizes[s])
        if not over:
            break
        left -= sum(limit * sizes[s] for s in over)
        open_ -= set(over)
    return target


def check(spark, rows, block=16):
    mixed = mixing.mix(docs(spark, rows), block=block).cache()
    got = [r.asDict() for r in mixing.taken(mixed).collect()]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    pieces = [r for r in mixed.collect() if r.slot is not None]
    assert all(0 <= r.start < r.end <= r["size"] for r in pieces)
    filled = {}
    for r in pieces:
        filled[r.slot] = filled.get(r.slot, 0) + r.end - r.start
    assert not filled or max(filled.values()) <= 4 * block + 4
    return sorted(map(str, got))


def test_mix_matches_plain_targets_and_reruns_agree(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40, 300]), rnd.choice(["a", "b", "B", "ä", "z", None, ""]) if rnd.random() < 0.6 else "hot") for i in range(400)]
    rows += [(1001, None, "a"), (1002, "", "empty"), (1003, "w", "tiny"), (1004, "w " * 20_000, "long"), (1005, "w w", "a"), (1005, "w w", "a")]
    assert check(spark, rows) == check(spark, list(reversed(rows)))


@pytest.mark.parametrize("rows", [[], [(1, "", None)], [(1, "one", None)], [(None, "a b c", "s"), (None, "a b c", "s")]])
def test_small_mixes(spark, rows):
    check(spark, rows)


def test_buckets_are_optimal():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 9)
        lengths, counts, k = rnd.sample(range(40), n), [rnd.randint(1, 9) for _ in range(n)], rnd.randint(1, 5)
        ends = packing.best_buckets(lengths, counts, k)
        padding = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))
        assert len(ends) <= k
        assert padding(ends) == min(padding({*p, max(lengths)}) for p in itertools.product(lengths, repeat=min(k, n) - 1))
    assert packing.best_buckets([], [], 4) == []


def test_pack_keeps_every_word_and_fills_batches(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.choice([0, 3, 3, 3, 17, 90, 250]), None) for i in range(500)] + [(7, None, None), (8, "w " * 5000, None), (8, "w " * 5000, None), (None, "w", None)]
    got = packing.pack(docs(spark, rows), buckets=5, budget=400, longest=200).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert all(r.padding == r.bucket_len - r.n_tokens >= 0 and r.n_tokens <= 200 for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for b in batches.values():
        room = max(400 // max(b[0].bucket_len, 1), 1)
        assert sorted(r.slot for r in b) == list(range(len(b))) and len(b) <= room
    for bucket in {r.bucket for r in got}:  # all but the last batch are full
        own = [b for (k, _), b in batches.items() if k == bucket]
        assert len(own) == -(-sum(map(len, own)) // max(400 // max(own[0][0].bucket_len, 1), 1))
    seen = {}
    for r in got:
        seen[r.n_tokens] = seen.get(r.n_tokens, 0) + 1
    assert sorted({r.bucket_len for r in got}) == packing.best_buckets(list(seen), list(seen.values()), 5)
    assert packing.pack(docs(spark, [])).count() == 0
    assert [r.n_tokens for r in packing.pack(docs(spark, [(1, None, None)])).collect()] == [0]
    twice = [(i, "w " * 30, None) for i in range(100)] * 2
    at = {}
    for r in packing.pack(docs(spark, twice), budget=120, longest=200).collect():
        at.setdefault(r.doc_id, []).append(r.batch)
    assert sum(len(set(b)) == 2 for b in at.values()) > 80  # copies lie in different batches, but for chance


def unsigned(spark, rows, *columns):
    """Spark's hash of the columns by id, as the operators order rows by it."""
    return {tuple(r)[:-1]: r.h % (1 << 64) for r in rows.select(*columns, F.xxhash64(F.lit(7), *columns).alias("h")).collect()}


def test_batches_by_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.choice([0, 3, 17, 90, 250, 601]), None) for i in range(300)]
    pieces = [(i, k, min(200, n - 200 * k)) for i, t, _ in rows for n in [len(t.split())] for k in range(max(n - 1, 0) // 200 + 1)]
    keys = unsigned(spark, spark.createDataFrame([p[:2] for p in pieces], "doc_id long, piece long"), "doc_id", "piece")
    ends = packing.best_buckets(*zip(*((n, sum(p[2] == n for p in pieces)) for n in {p[2] for p in pieces})), 5)
    want = set()
    for b, end in enumerate(ends):
        own = sorted((p for p in pieces if p[2] <= end and (b == 0 or p[2] > ends[b - 1])), key=lambda p: keys[p[:2]])
        room = max(400 // max(end, 1), 1)
        want |= {(*p, b, at // room, at % room) for at, p in enumerate(own)}
    got = {(r.doc_id, r.piece, r.n_tokens, r.bucket, r.batch, r.slot) for r in packing.pack(docs(spark, rows), buckets=5, budget=400, longest=200).collect()}
    assert got == want


def test_pieces_of_the_mix_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40, 300]), rnd.choice(["a", "b", "ä", None])) for i in range(150)]
    block, sizes = 64, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = plain_targets(sizes)
    take = {s: min(int(target[s] + 0.5), 2 * sizes[s]) for s in sizes}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    total = sum(take.values())
    slots = {s: [] for s in names}
    for t in range(-(-total // block)):
        u, hi = (0.5 + t * mixing.GOLDEN) % 1.0, 0
        for s in names:
            hi += take[s]
            if u < hi / total:
                slots[s].append(t)
                break
    keys = unsigned(spark, docs(spark, rows), "doc_id")
    want = set()
    for s in names:
        base, extra = divmod(take[s], len(slots[s]))
        edges = [k * base + min(k, extra) for k in range(len(slots[s]) + 1)]
        at = 0
        line = sorted((r for r in rows if r[2] == s), key=lambda r: keys[r[:1]])
        for p in (0, 1):
            for i, t, _ in line:
                n = len(t.split())
                for k, slot in enumerate(slots[s]):
                    lo, hi = max(at, edges[k]), min(at + n, edges[k + 1])
                    if lo < hi:
                        want.add((i, slot, p, lo - at, hi - at))
                at += n
    got = {(r.doc_id, r.slot, r["pass"], r.start, r.end) for r in mixing.mix(docs(spark, rows), block=block).collect() if r.slot is not None}
    assert got == want
