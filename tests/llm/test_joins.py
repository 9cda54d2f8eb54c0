"""The Jaccard join and the top-k search against brute force on crowds, hot passages, small sets and odd rows."""

import random

import numpy as np
import pytest

from dialoom.llm import jaccard, topk


def brute(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), ids told apart."""
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[:p]:
            x, y = sets[a], sets[b]
            if x and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and root(a) != root(b) and 100 * len(x & y) >= 80 * len(x | y):
                c, d = sorted((root(a), root(b)))
                up[d] = c
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def found(spark, rows, **names):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, key string")
    return sorted(map(tuple, jaccard.near_duplicates(docs).collect()))


def changed(made, words, share):
    return [f"new{made.randrange(10**6)}" if made.random() < share else w for w in words]


def texts(seed):
    """Chains of near copies, a crowd of near copies, a passage and short boilerplate that many texts share, sets of all small sizes."""
    made, rows = random.Random(seed), []
    fresh = lambda n: [f"w{made.randrange(3000)}" for _ in range(n)]
    for _ in range(12):
        base = fresh(made.choice([6, 12, 30, 70, 150, 400]))
        rows += [base := changed(made, base, 0.02) for _ in range(8)]
    base = fresh(120)
    rows += [changed(made, base, 0.012) for _ in range(90)]
    passage = fresh(60)
    rows += [[*fresh(15), *passage, *fresh(15)] for _ in range(60)]
    rows += [[*passage, *fresh(made.randrange(12))] for _ in range(60)]
    short = fresh(8)
    rows += [[*short, *fresh(made.randrange(3))] for _ in range(60)]
    rows += [fresh(n) for n in range(24)]
    return [(k * 7 % 1009, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("seed, crowd, block, long", [(2, 4, 16, 8)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, crowd, block, long):
    """With small limits, so that crowds, blocks and long buckets all occur."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LONG", long)
    rows = texts(seed)
    want = brute(rows)
    assert found(spark, rows) == want and len({c for _, _, c in want}) < len(rows) - 150


def test_sets_with_too_few_segments(spark):
    """Pairs by prefixes are all pairs of fitting size that are similar, and more."""
    rows = texts(5)[:150]
    docs = spark.createDataFrame(rows, "doc long, text string")
    full = spark.createDataFrame([(i, True) for i, _ in rows], "doc long, few boolean")
    pairs = {(r.a, r.b) for r in jaccard._lost_pairs(docs, full, 5).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows if t}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near and near <= pairs


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "One Two\tthree  four"), (8, "a " * 40_000), (9, "A " * 30_000), (10, "a")]
    assert found(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(1, "x y", "k"), (1, "x y", "l"), (2, "x y", "m"), (None, "x y", "n")], "doc_id long, text string, first_of_class string")
    assert sorted(map(tuple, jaccard.keep_one(docs).collect()), key=repr) == sorted([(1, "x y", "k"), (1, "x y", "l"), (None, "x y", "n")], key=repr)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def best(vectors, queries, k=10):
    want = []
    for q, x in queries:
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in vectors if i != q)[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(want)


@pytest.mark.parametrize("chunk, block", [(7, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, chunk, block):
    """Ties, repeated vectors, zero vectors, vectors of other lengths, and very unequal norms."""
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    made = np.random.default_rng(6)
    vectors = [(i, (made.integers(-50, 50, 8) * (1 if i % 10 else 40)).tolist()) for i in range(200)]
    vectors += [(300 + i, [1] * 8) for i in range(30)] + [(400, [0] * 8), (401, [5, 5]), (402, []), (500, [10**6] * 8), (-100, [40_000] * 8)]
    rows = spark.createDataFrame(vectors, "vec_id long, z array<long>")
    out = topk.top_k(rows, rows.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, out.collect())) == best(vectors, [v for v in vectors if v[0] % 100 == 0])


def test_top_k_of_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, rank int, block long, size string"
    rows = [(100, [0.5, -0.25], 1, 1, "s"), (200, None, 1, 1, "s"), (300, [float("nan"), 1.0], 1, 1, "s"), (301, [None, 1.0], 1, 1, "s"), (1, [1.0, 1.0], 1, 1, "s"), (1, [1.0, 1.0], 1, 1, "s"), (None, [1.0, 1.0], 1, 1, "s")]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, kind))
    out = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, out.collect())) == [(100, 1, 1, 512 * 1024 - 256 * 1024), (100, 2, 1, 512 * 1024 - 256 * 1024)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == [] and topk.top_k(vectors, vectors.limit(0)).columns == out.columns
    huge = spark.createDataFrame([(100, [3 * 10**9] * 4), (1, [3 * 10**9] * 4)], "vec_id long, z array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, huge).collect()
