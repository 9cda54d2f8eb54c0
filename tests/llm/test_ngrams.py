import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dialoom.llm import ngrams

DOCS = [
    (1, "the cat sat on the mat"), (2, "the cat sat on the hat"), (3, "The dog sat"), (4, None), (5, ""), (6, "a b a b a b a b"),
    (7, "the\tdog\nran on the mat and the cat ran"), (7, "the\tdog\nran on the mat and the cat ran"), (None, "the end"), (9, "unseen words é"),
]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def brute(texts, order):
    """Probability function of an interpolated modified Kneser-Ney model, from dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        seq = ["<s>"] * (order - 1) + tokens(t)
        counts[order].update(tuple(seq[i : i + order]) for i in range(len(seq) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter()
        for gram, n in counts[k + 1].items():
            counts[k][gram[1:]] += n if gram[1] == "<s>" else 1
    d = {k: ngrams.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    per = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for gram, n in c.items():
            per[k][gram[:-1]].append(n)
    vocabulary = {w for t in texts for w in tokens(t)}

    def p(gram):
        if not gram:
            return 1 / (len(vocabulary) + 1)
        k, rest = len(gram), p(gram[1:])
        if not (there := per[k].get(gram[:-1])):
            return rest
        n = counts[k][gram]
        return (max(n - d[k][min(n, 3)], 0) + sum(d[k][min(x, 3)] for x in there) * rest) / sum(there)

    return p, vocabulary


@pytest.mark.parametrize("order, common", [(2, 1), (3, 4)])
def test_model_equals_brute_force(spark, order, common):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, keys int")
    held = docs.where("doc_id = 9")
    model = ngrams.train(docs.where("doc_id IS NULL OR doc_id <> 9"), order, tokens_a_shard=5, common=common)
    texts = [t for i, t in DOCS if i != 9]
    p, vocabulary = brute(texts, order)
    counts = Counter(w for t in texts for w in tokens(t))
    n = sum(counts.values())
    rows = ngrams.score(docs, model).collect()
    assert len(rows) == len(DOCS) and held.count() == 1
    expected = {}
    for i, t in DOCS:
        seq = ["<s>"] * (order - 1) + tokens(t)
        logs = sum(math.log10(p(tuple(seq[j : j + order]))) for j in range(len(seq) - order + 1))
        base = sum(math.log10((counts[w] + 1) / (n + len(vocabulary) + 1)) for w in tokens(t))
        expected[i] = (len(tokens(t)), sum(w in counts for w in tokens(t)), n, base, logs)
    for r in rows:
        want = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-6)
    for context in (("the",), ("a",), ("never",)):
        context = ("<s>",) * (order - 2) + context
        assert sum(p((*context, w)) for w in [*vocabulary, "<unknown>"]) == pytest.approx(1)


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = ngrams.train(docs)
    assert ngrams.score(docs, model).count() == 0
    one = ngrams.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (2, 0, 0, 0.0, 0.0)


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "ab " * 700_000 + "x" * 3_000_000)], "doc_id long, text string")
    row = ngrams.score(docs, ngrams.train(docs)).first()
    assert row.n_tokens == 700_002 == row.n_known and row.score > row.base_score


def test_registered_query_is_a_trigram_model(spark, tmp_path):
    rows = [(i, f"{t} again" if i % 2 else t) for i, (_, t) in enumerate(DOCS * 4) if t]
    rows.append((10_001, "the cat " * 400))  # counts beyond a byte
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in ngrams.op9_ngram_scores(spark, str(tmp_path)).collect()}
    p, _ = brute([t for i, t in rows if not found[i].held_out], 3)
    assert len(found) == len(rows) and any(r.held_out for r in found.values())
    for i, t in rows:
        seq = ["<s>"] * 2 + tokens(t)
        assert found[i].score == pytest.approx(sum(math.log10(p(tuple(seq[j : j + 3]))) for j in range(len(seq) - 2)), rel=1e-9)


def test_packing_is_lossless():
    made = np.random.default_rng(1)
    for form, most in ((np.uint32, 200), (np.uint32, 40_000), (np.uint64, 1 << 40)):
        keys = made.integers(0, 1 << 32, (1000, 3), dtype=np.uint64).astype(form)
        keys[:500, 0] = 7
        counts = made.integers(0, most, (2, 1000))
        found, sums = ngrams._row_sums(keys, counts)
        k, c = ngrams._unpacked(*ngrams._packed(found, sums))
        assert (k == found).all() and (c == sums).all()
        assert sorted(map(tuple, np.c_[keys, counts.T].tolist())) == sorted(map(tuple, np.c_[k, c.T].tolist()))


def test_hash_arrays(tmp_path):
    made = np.random.default_rng(2)
    for n in (1, 5, 3000):
        keys, absent = made.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        numbers = made.integers(1, 300, (4, n))
        arrays = ngrams.Arrays(f"file://{tmp_path}/{n}", {"x": b"\x01"})
        arrays.write_hashed("x", 0, keys, numbers)
        found, there = arrays.find("x", 4, np.r_[keys, absent], np.zeros(2 * n, np.int64))
        assert there.tolist() == [True] * n + [False] * n and (found[:, :n] == numbers).all() and not found[:, n:].any()


def test_long_words_do_not_collide():
    from dialoom.llm.shingles import word_hashes

    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    assert word_hashes(a)[0] != word_hashes(b)[0] and word_hashes(a)[0] == word_hashes(a.upper())[0]
