"""Each query over a whole small table against a brute-force version."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from dialoom.llm import registry

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    want = sorted(map(tuple, db.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_op1_totals(spark):
    found = registry.QUERIES["op1_mixing_sources"](spark, SF).collect()
    assert len(found) == len(rows("documents"))
    per = {}
    for r in found:
        assert r.taken <= 3 * r["size"]
        x = per.setdefault((r.source_size, r.target), [0])
        x[0] += r.taken
    total = sum(s for s, _ in per)
    assert sum(t for _, t in per) == pytest.approx(total)


def test_op2(spark):
    data = rows("embeddings")
    ids, good = [r["vec_id"] for r in data], []
    for r in data:
        x = None if r["embedding"] is None or any(v is None for v in r["embedding"]) else np.array(r["embedding"], np.float64)
        if x is not None and np.isfinite(x).all() and x.any() and r["label"] is not None:
            good.append((r["vec_id"], r["label"], x / np.linalg.norm(x)))
    links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[:i] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] >= 0.98]
    of = components(ids, links)
    found = {r.vec_id: r for r in registry.QUERIES["op2_embedding_near_dedup"](spark, SF).collect()}
    assert set(found) == set(ids)
    n = dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert sum(r.n_links for r in found.values()) >= 0.99 * sum(n.values()) and all(found[i].n_links <= n[i] for i in ids)
    assert np.mean([found[i].component_id == of[i] for i in ids]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_op3(spark):
    found = {r.doc_id: r for r in registry.QUERIES["op3_secret_scans"](spark, SF).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in rows("documents"):
        t = r["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        got = found[r["doc_id"]]
        assert got.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert set(filter(None, base.split(","))) <= set(got.spans.split(","))


def test_op5(spark):
    sets, by = {}, {}
    for r in rows("documents"):
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r["doc_id"]]:
            by.setdefault(s, []).append(r["doc_id"])
    links = set()
    for a, x in sets.items():
        shared = {}
        for s in x:
            for b in by[s]:
                shared[b] = shared.get(b, 0) + 1
        links |= {(a, b) for b, n in shared.items() if a != b and 100 * n >= 80 * (len(x) + len(sets[b]) - n)}
    of = components(sets, links)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.QUERIES["op5_jaccard_join"](spark, SF).collect()}
    assert found == {d: (len(x), of[d]) for d, x in sets.items()}


def test_op6(spark):
    found = {r.doc_id: r for r in registry.QUERIES["op6_quality"](spark, SF).collect()}
    assert set(found) == {r["doc_id"] for r in rows("documents")}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r["quality"], found[r["doc_id"]].predicted) for r in rows("labels") if r["doc_id"] in found and found[r["doc_id"]].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.8


def test_op8(spark):
    vectors = {}
    for r in rows("embeddings"):
        x = r["embedding"]
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            vectors[r["vec_id"]] = np.floor(1024 * np.array(x, np.float64)).astype(np.int64)
    want = set()
    for q, x in vectors.items():
        if q % 100 == 0:
            best = sorted((-int(x @ y), v) for v, y in vectors.items() if v != q)[:10]
            want |= {(q, k + 1, v, -s) for k, (s, v) in enumerate(best)}
    assert set(map(tuple, registry.QUERIES["op8_exact_top_k"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == want


def test_op9(spark):
    found = {r.doc_id: r for r in registry.QUERIES["op9_ngram_scores"](spark, SF).collect()}
    docs = rows("documents")
    counts = {}
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            for w in [*words(r["text"]), None]:
                counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    logs, base = 0.0, 0.0
    for r in docs:
        got, mine = found[r["doc_id"]], [*words(r["text"]), None]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(mine), sum(w in counts for w in mine), n)
        assert got.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in mine), rel=1e-9)
        if got.held_out:
            logs, base = logs + got.score, base + got.base_score
    assert logs > base  # context helps on texts that were not learned


def test_op10(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op10_bpe"](spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows("documents"):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert found[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
