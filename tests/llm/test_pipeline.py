"""The quality scores against plain densities, and the whole pipeline against a plain version, on a small fixture."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from dialoom.llm import bpe, mixing, quality, secrets
from tests.llm.test_joins import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long, x array<double>"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re") for b in ("na", "to", "su", "vi", "pe") for c in ("", "n", "ra", "st")]


def fixture():
    made, rows, labels = random.Random(8), [], []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(made.choices(WORDS, k=made.randint(20, 60))).capitalize() + "." if good else " ".join(["$$$ 000 ###", *made.choices(["CLICK", "BUY", "!!!", "1999"], k=made.randint(5, 40))])
        if i % 20 == 1:
            text += " The passphrase -> kq#7Zw!pLx and token=abcdef123456 end here."
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text), None))
        labels.append((i, int(good)))
    rows += [(1000 + i, rows[i][1] + " more", "en", "s1", 3, None) for i in range(1, 60, 7)] + [rows[5], rows[5]]
    rows += [(2000, None, "en", "s0", None, None), (2001, "", "en", "s0", 0, None), (None, rows[4][1], "en", "s0", 1, None)]
    return rows, [*labels, (3, None), (9999, 1), (7, 2), (4, 1)]


def scores(rows, labels):
    """Per text: the score by densities of normal distributions with shrunk covariances, by numpy's solver."""
    of = {i: np.array(quality.statistics(t)) for i, t, *_ in rows}
    x = [(q, np.array(quality.statistics(t))) for i, t, *_ in rows for j, q in labels if i == j and q in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    per = {k: np.stack([v for q, v in x if q == k]) for k in (0, 1)}
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in per.values()) / len(x)

    def density(k, v):
        cov = 0.82 * np.cov(per[k].T, bias=True) + 0.15 * pooled + 0.03 * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
        away = v - per[k].mean(axis=0)
        return math.log(len(per[k])) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * away @ np.linalg.solve(cov, away)

    return [1 / (1 + math.exp(-np.clip(density(1, v) - density(0, v), -700, 700))) for v in (np.array(quality.statistics(t)) for _, t, *_ in rows)], of


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_scores_equal_densities(spark, tmp_path):
    rows, labels = fixture()
    found = quality.op6_quality(spark, tables(spark, tmp_path, rows, labels)).collect()
    want = Counter((i, round(s, 6)) for (i, *_), s in zip(rows, scores(rows, labels)[0]))
    assert Counter((r.doc_id, round(r.score, 6)) for r in found) == want
    by = dict(labels)
    held = [r for r in found if r.held_out and by.get(r.doc_id) in (0, 1)]
    assert len(held) > 50 and np.mean([r.predicted == by[r.doc_id] for r in held]) >= 0.95


def test_quality_without_labels(spark, tmp_path):
    rows, _ = fixture()
    found = quality.op6_quality(spark, tables(spark, tmp_path, rows[:5], [(0, 1)])).collect()
    assert [r.score for r in found] == [pytest.approx(2 / 3)] * 5


def plain(rows, labels):
    """The pipeline in plain Python: rows of (doc_id, source, number of tokens, ids)."""
    rows = [r for r, s in zip(rows, scores(rows, labels)[0]) if s >= 0.5]
    # each class's first; two texts of one id do not occur here
    of = {i: c for i, _, c in brute([(i, t) for i, t, *_ in rows if i is not None])}
    rows = [r for r in rows if r[0] is None or of[r[0]] == r[0]]
    counts = Counter(w for r in rows for w in secrets.plain_words(r[1] or "", secrets.credentials(r[1] or "")))
    ranks = {w: k + 1 for k, w in enumerate(secrets.COMMON)}
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        ranks.setdefault(w, len(ranks) + 1)
    rows = [(i, None if t is None else secrets.masked(t, secrets.scan(t, ranks=ranks)), *r) for i, t, *r in rows]
    sizes = Counter()
    for _, t, _, source, *_ in rows:
        sizes[source] += len((t or "").split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(filter(None, sizes)) + [None] * (None in sizes))}
    full: set = set()
    while True:  # shares by weight, sources above their cap set to it, until none is above
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: left * w / sum(v for k, v in weight.items() if k not in full) for s, w in weight.items() if s not in full}
        if not (over := {s for s, n in share.items() if n > 3 * sizes[s]}):
            break
        full |= over
    rate = {s: 3.0 if s in full else share[s] / sizes[s] if sizes[s] else 0.0 for s in sizes}
    tokenizer, out = bpe.load(open(bpe.default_path(), encoding="utf-8").read()), []
    for i, t, _, source, *_ in rows:
        u = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        whole = math.floor(rate[source])
        ids = tokenizer.encode_ids(t)
        out += [(i, source, len(ids), tuple(ids))] * (whole + (u < rate[source] - whole))
    return out


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows, labels = fixture()
    found = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, labels))
    got = Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in found.collect())
    want = Counter(plain(rows, labels))
    assert got == want and 50 < sum(want.values())
    assert {i for i, *_ in got if i and 1000 <= i < 2000} == set()  # near copies go
    assert not any(i is not None and i < 240 and i % 3 == 0 for i, *_ in got)  # rejected texts go
    assert mixing.WEIGHTS == (5, 2, 1)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_codes_of_odd_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    texts = [None, "", " ", "<|endoftext|> a<|startoftext|>", "ΣΑΣ ǅ İ ﬁ é Å", "x" * 50_000, "don't we'LL 12three", "a\x00b\x1c c d e", "\U0001f600 𝔸 中文", "ab " * 300_000, "same", "same"]
    docs = spark.createDataFrame([(i, x, "t") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.code(docs).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False), texts[r.doc_id][:40]
    assert bpe.code(docs.limit(0)).count() == 0
