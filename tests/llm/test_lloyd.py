"""Centroid clusters against their SQL, and against plain whole-number loops on odd and huge components."""

import hashlib
import math
import random

import duckdb

from dialoom.llm import lloyd, registry

SCHEMA = "vec_id long, embedding array<float>, label int, z string, n int, cluster string"


def brute(rows, k=8, rounds=10, d=64):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == d and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * v))) for v in x]))
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), z) for i, z in kept if i is not None)
    centroids = [z for _, z in order[:k]]
    far = lambda z, c: sum((a - b) ** 2 for a, b in zip(z, c))
    pick = lambda z: min(range(len(centroids)), key=lambda c: (far(z, centroids[c]), c))
    for _ in range(rounds):
        at = [pick(z) for _, z in kept]
        for c in range(len(centroids)):
            mine = [z for a, (_, z) in zip(at, kept) if a == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    most = (1 << 63) - 1
    made = [(i, c := pick(z), min(most, far(z, centroids[c]))) for i, z in kept]
    inertia = [sum(x for _, a, x in made if a == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, x, min(most, inertia[c]), min(most, sum(inertia)), sha[c]) for i, c, x in made), key=repr)


def sample(n, seed, scale=1.0):
    rng = random.Random(seed)
    grid = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(12)]
    return [(i, [float.fromhex(float(v).hex()) for v in (grid[i % 12] if i % 3 else [v + rng.gauss(0, scale / 4) for v in grid[i % 12]])]) for i in range(n)]


def test_clusters_equal_sql_and_loops(spark, tmp_path):
    rows = sample(400, 1) + [(1000 + i, [0.25] * 64) for i in range(300)]
    rows += [(2000, None), (2001, []), (2002, [None] * 64), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (2005, [1.0] * 63), (2006, [0.0] * 64), (None, [0.5] * 64), (7, rows[7][1])]
    spark.createDataFrame([(i, x, 1, "z", 2, "c") for i, x in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = registry.QUERIES["op11_centroid_clusters"](spark, str(tmp_path))
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted(map(tuple, df.select(*names).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL['op11_centroid_clusters']})").fetchall(), key=repr)
    exact = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    assert got == brute(exact) and len(got) == 703
    assert df.where("vec_id >= 1000").count() == 301
    salted = lloyd.clusters(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), hot=100)
    assert sorted(map(tuple, salted.select("vec_id", "cluster", "distance").collect()), key=repr) == [r[:3] for r in got]
    assert {r["multiplicity"] for r in salted.where("vec_id >= 1000 and vec_id < 1300").collect()} == {300}


def test_huge_few_and_no_vectors(spark):
    for scale in (3e4, 1e9, 1e16, 1e35):
        df = spark.createDataFrame([(i, x, 1, "z", 2, "c") for i, x in sample(60, 2, scale)], SCHEMA)
        exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
        found = lloyd.clusters(df)
        rows = [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in found.collect()]
        assert sorted(rows, key=repr) == brute(exact)
    few = spark.createDataFrame([(i, [float(i)] * 64, 1, "z", 2, "c") for i in range(3)], SCHEMA)
    assert sorted((r["vec_id"], r["distance"]) for r in lloyd.clusters(few).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert lloyd.clusters(few.limit(0)).collect() == []
    assert lloyd.clusters(few.where("vec_id > 5")).columns == lloyd.clusters(few).columns
