import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from brightloom.llm import resemblance, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size long, part int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "k", 1, 1) for i, t, s in rows], SCHEMA)


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def edges():
    """Texts with a length of their own each, so that pieces tell them: null and repeated ids, copies under both."""
    rnd = random.Random(5)
    text = {n: prose(rnd, n) for n in range(50, 62)}
    rows = [(1, text[50]), (9, text[50]), (9, text[51]), (None, text[52]), (None, text[53]), (None, text[53].upper()), (4, text[54]), (4, text[54])]
    rows += [(4, text[55]), (None, text[55]), (7, text[56]), (7, text[57]), (7, text[58]), (8, None), (10, ""), (11, "1 2 3"), (None, text[59]), (12, text[60]), (13, text[61])]
    return [(i, t, "a") for i, t in rows]  # one source, of which the mix takes 1.5 times all words


def plain_copies(rows):
    best = {}
    for r in rows:
        t = (r[1] or "").lower()
        if t not in best or (r[0] is None, r[0] or 0) < (best[t][0] is None, best[t][0] or 0):
            best[t] = r
    return Counter((r[0], (r[1] or "").lower()) for r in best.values())


def kept(df):
    return Counter((r.doc_id, (r.text or "").lower()) for r in df.collect())


def test_exact_copies_by_row(spark):
    assert kept(pipeline.drop_copies(spark, docs(spark, edges()), "")) == plain_copies(edges())
    assert pipeline.drop_copies(spark, docs(spark, []), "").count() == 0


def test_mix_takes_each_row_once_or_twice(spark):
    rows = [r for r in edges() if r[1]]
    got = Counter((r.doc_id, r.text) for r in pipeline.mix_sources(spark, docs(spark, rows), "").collect())
    there = Counter((i, t) for i, t, _ in rows)
    assert set(got) == set(there) and all(there[k] <= got[k] <= 2 * there[k] for k in there)
    assert pipeline.mix_sources(spark, docs(spark, []), "").count() == 0


def test_run_keeps_null_and_repeated_ids(spark, tmp_path):
    docs(spark, edges()).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens) for r in pipeline.run(spark, str(tmp_path)).collect())
    want = {(i, len(t.split())) for (i, t) in plain_copies(edges()) if any(c.isalpha() for c in t)}
    assert set(got) == want and all(1 <= n <= 2 for n in got.values())


def test_run_of_nothing(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def families(rnd):
    """Texts near each other at shingle similarities about 0.8 to 0.95 and below, in pairs, chains and a large group."""
    found = []

    def changed(words, k):
        out = list(words)
        for at in rnd.sample(range(len(out)), k):
            out[at] = prose(rnd, 1)
        return out

    for k in (1, 2, 3, 4, 5, 6, 8, 10, 15):  # words changed of 220
        for _ in range(3):
            base = prose(rnd, 220).split()
            found += [base, changed(base, k)]
    chain = prose(rnd, 220).split()
    for _ in range(12):
        chain = changed(chain, 4)
        found.append(chain)
    hub = prose(rnd, 220).split()
    found += [changed(hub, 2) for _ in range(70)]
    found += [changed(hub, 9) for _ in range(25)]
    short = prose(rnd, 4).split()
    found += [short, short[:3], [*short[:3], "other"], prose(rnd, 60).split()]
    rnd.shuffle(found)
    return [" ".join(w).upper() if k % 7 == 0 else " ".join(w) for k, w in enumerate(found)]


def plain_groups(texts, width=5, limit=0.8):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= limit * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(texts))]


@pytest.mark.parametrize("chunk, size", [(512, None), (8, None), (2, 40)])
def test_near_copies_are_those_of_all_pairs(spark, chunk, size):
    texts = families(random.Random(11))[:size]
    table = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    first = simhash.near_links(table, "row", width=5)
    for links in (None, first):
        found = resemblance.near_copies(table, "row", chunk=chunk, first=links)
        got = {r.node: r.root for r in found.collect()}
        assert [got.get(i, i) for i in range(len(texts))] == plain_groups(texts)


def test_language_stage_drops_only_what_has_no_letter(spark):
    rows = [*edges(), (20, None, None), (21, "!!", "b"), (22, "é", "b")]
    left = pipeline.identify_language(spark, docs(spark, rows), "")
    assert left.columns[:5] == list(pipeline.COLUMNS)
    assert Counter((r.doc_id, r.text, r.source) for r in left.collect()) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_packing_stage_is_all_words_once(spark):
    rows = [*edges(), (30, "w " * 20_000, None)]
    got = Counter()
    for r in pipeline.pack_lengths(spark, docs(spark, rows), "").collect():
        got[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert got == want


def test_near_stage_keeps_one_row_a_group(spark):
    rnd = random.Random(12)
    texts = families(rnd)
    ids = [rnd.choice([None, 5, 5, *range(100, 400)]) for _ in texts]
    want, groups = [], plain_groups(texts)
    for root in set(groups):
        mine = [ids[i] for i, g in enumerate(groups) if g == root]
        want.append(min((i for i in mine if i is not None), default=None))
    left = pipeline.drop_near_copies(spark, docs(spark, [(i, t, "a") for i, t in zip(ids, texts)]), "").collect()
    assert Counter(r.doc_id for r in left) == Counter(want)
    at = {t: groups[i] for i, t in enumerate(texts)}
    assert len({at[r.text] for r in left}) == len(left)
    assert pipeline.drop_near_copies(spark, docs(spark, []), "").count() == 0
