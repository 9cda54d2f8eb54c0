"""Near vectors against all pairs, on planted pairs, crowds and odd rows."""

import numpy as np
import pytest

from dialoom.llm import embeddings

KIND = "vec_id long, embedding array<float>, label int, rep long, key string"


def planted(made, n, d, cosine):
    """n unit vectors, and n whose cosine to them is as given."""
    x, y = made.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


def brute(rows, least=0.98):
    """(links per row's (id, place), component per id) of usable rows."""
    good = []
    for k, (i, x, label, *_) in enumerate(rows):
        if i is not None and label is not None and x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x):
            x = np.array(x, np.float32).astype(np.float64)
            good.append((k, i, label, x / np.linalg.norm(x)))
    links, up = dict.fromkeys(range(len(rows)), 0), {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for label, size in {(label, len(x)) for _, _, label, x in good}:
        mine = [g for g in good if g[2] == label and len(g[3]) == size]
        x = np.stack([g[3] for g in mine])
        near = (x @ x.T >= least) | (x[:, None] == x).all(axis=2) if len(x) < 500 else x @ x.T >= least
        for p, m in zip(*np.nonzero(np.triu(near, 1))):
            links[mine[p][0]] += 1
            links[mine[m][0]] += 1
            a, b = sorted((root(mine[p][1]), root(mine[m][1])))
            up[b] = a
    return links, {i: root(i) for i in list(up)}


def found(spark, rows, **how):
    out = embeddings.near_vectors(spark.createDataFrame(rows, KIND), **how).collect()
    assert len(out) == len(rows) and all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)
    return out


@pytest.mark.parametrize("d, hashes", [(64, None)])
def test_planted_pairs_are_found(spark, d, hashes):
    """Pairs at the threshold are the hardest: recall on them is 0.99 or more, and nothing below it links."""
    made = np.random.default_rng(d)
    rows, n = [], 400
    for k, cosine in enumerate((0.981, 0.99, 0.999, 0.975)):
        x, y = planted(made, n, d, cosine)
        rows += [(k * 10_000 + i, v.tolist(), i % 3, 0, "") for i, v in enumerate(np.concatenate([x, y]))]
    rows = [(i, v, (i % 10_000) % n % 3, *r) for i, v, _, *r in rows]
    got = {r.vec_id: r for r in found(spark, rows, hashes=hashes)}
    links, _ = brute(rows)
    want = [(i, links[k]) for k, (i, *_) in enumerate(rows)]
    assert sum(n for _, n in want) >= 2300 and all(got[i].n_links <= n for i, n in want)
    assert sum(got[i].n_links for i, _ in want) >= 0.99 * sum(n for _, n in want)
    assert all(got[i].n_links == 0 for i in got if i >= 30_000)


@pytest.mark.parametrize("block", [8])
def test_crowds_equal_all_pairs(spark, block):
    """Groups of near copies and of equal vectors, larger than a block, with all their links."""
    made = np.random.default_rng(3)
    rows = []
    for g in range(3):
        centre = made.normal(size=32)
        for k in range(60):
            x = centre + 0.05 * made.normal(size=32) if k % 3 else centre
            rows.append((len(rows), x.tolist(), g % 2, 0, ""))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found(spark, rows, block=block)}
    links, classes = brute(rows)
    want = {i: (links[k], classes.get(i, i)) for k, (i, *_) in enumerate(rows)}
    assert sum(n for n, _ in got.values()) >= 0.995 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got) and all(got[i][1] == want[i][1] for i in want)


def test_odd_rows(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (5, one, 1, 9, "k"), (5, one, 1, 9, "k"), (7, [2.0, 4.0, 6.0], 1, 9, "k"), (8, one, 2, 9, "k"), (9, one, None, 9, "k"), (10, None, 1, 9, "k"),
        (11, [0.0, 0.0, 0.0], 1, 9, "k"), (12, [nan, 1.0, 1.0], 1, 9, "k"), (13, [inf, 1.0, 1.0], 1, 9, "k"), (14, [None, 1.0], 1, 9, "k"), (15, [], 1, 9, "k"),
        (None, one, 1, 9, "k"), (16, [1.0, 2.0], 1, 9, "k"), (17, [1e38, 2e38, 3e38], 1, 9, "k"), (18, [-1.0, -2.0, -3.0], 1, 9, "k"), (19, [4.0], 3, 9, "k"), (20, [5.0], 3, 9, "k"),
    ]
    got = {}
    for r in found(spark, rows):
        got.setdefault(r.vec_id, set()).add((r.n_links, r.component_id))
    assert got == {
        5: {(3, 5)}, 7: {(3, 5)}, 17: {(3, 5)}, 19: {(1, 19)}, 20: {(1, 19)}, None: {(0, None)},
        **{i: {(0, i)} for i in (8, 9, 10, 11, 12, 13, 14, 15, 16, 18)},
    }
    assert embeddings.near_vectors(spark.createDataFrame([], KIND)).count() == 0
