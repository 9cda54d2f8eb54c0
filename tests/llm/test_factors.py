"""Substring dedup against its SQL and plain loops, with limits so small that blocks and shards split everything."""

import random

import duckdb
import pytest

from dialoom.llm import factors, registry

SCHEMA = "doc_id long, text string, kept string, spans int, found string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeABCDE") for _ in range(rng.randint(2, 7)))
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 40, 200)]
    rows = []
    for i in range(240):
        words = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            passage, at = rng.choice(passages), rng.randint(0, len(words))
            cut = rng.randint(0, 5) if rng.random() < 0.3 else 0
            words[at:at] = passage[cut:]
        gap = rng.choice([" ", "\n", "\t ", " \x0b", "\x0c"])
        rows.append((i, gap.join(words) + rng.choice(["", " "])))
    rows += [(300 + i, " ".join(passages[4])) for i in range(50)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "w " * 12), (404, "v " * 60), (405, "v " * 60), (406, "v v " * 20), (406, "naïve 日本 " * 20)]
    rows += [(500, " ".join(passages[3])), (500, " ".join(passages[3] + passages[3])), (None, " ".join(passages[3])), (None, None), (501, " ".join(p for q in passages for p in q).upper())]
    rows += [(600, " ".join(word() for _ in range(30_000)) + " " + " ".join(passages[4])), (-3, " ".join(passages[1])), (9_000_000_000_000_000_000, " ".join(passages[1]))]
    rng.shuffle(rows)
    return rows


def brute(rows, width=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        if i is not None:
            for k in range(len(words) - width + 1):
                w = tuple(words[k : k + width])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if i is not None and first[tuple(words[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,shard", [(1 << 21, 1 << 24), (40, 2000), (1 << 21, 300)])
def test_removed_words_equal_loops(spark, monkeypatch, block, shard):
    rows = corpus()
    monkeypatch.setattr(factors, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, "k", 1, "f") for i, t in rows], SCHEMA).repartition(7)
    if block == 40:
        docs = docs.where("doc_id is null or doc_id <> 600")
        rows = [r for r in rows if r[0] != 600]
    found = factors.without_repeats(docs, shard_bytes=shard).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == brute(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode().split())
    n_spans = 0
    for r in found:
        covered = set()
        for s in r["spans"]:
            n_spans += 1
            assert s["words"] >= 13 and s["reference"] < r["doc_id"]
            mine = [w[s["start"] : s["start"] + s["words"]] for w in texts[r["doc_id"]]]
            there = [w[s["reference_start"] : s["reference_start"] + s["words"]] for w in texts[s["reference"]]]
            assert any(m in there for m in mine if len(m) == s["words"])
            covered.update(range(s["start"], s["start"] + s["words"]))
        assert len(covered) == r["n_removed"]
    assert n_spans > 100


def test_query_equals_sql(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "k", 1, "f") for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["op13_substring_dedup"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL['op13_substring_dedup']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    empty = factors.without_repeats(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_removed", "kept", "spans"]
