"""Centroid clustering by weighted deduplication: Lloyd's rounds on distinct quantised vectors, in whole numbers.

Vectors are quantised and packed into as few bytes as they need; identical ones are one row with a multiplicity, counted with
partial sums before the shuffle. A round sends the centroids to the tasks, which return weighted sums per cluster: k times d
whole numbers, however long the table. Sums and distances are exact: 64-bit or float arithmetic only where nothing can be lost,
Python's whole numbers elsewhere. At last each distinct vector's cluster is joined back to the ids. A vector that very many ids
share is dealt over several tasks there: the values that more than one row in HOT has are HOT at most, so their list is small.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; rows that
repeat an id are vectors each; a vector with a null id is clustered but starts no centroid; of rows with one id the vector
whose packed bytes come first starts first; with fewer vectors than k there are fewer centroids; equal vectors may start two
centroids, of which the later stays empty; components beyond 64 bits count as the nearest number of 64 bits, and distances and
inertias beyond them are returned as the largest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.shared import Scratch, table

K, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: A value that more than one row in so many has is dealt over several tasks; no more than so many values can be.
HOT = 1024
#: Vectors of a batch whose distances are held at once.
PIECE = 4096
MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, d: int = DIMENSIONS, scale: int = SCALE, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """vec_id long, z binary, spread int: floor(scale * x) of every component, in the narrowest whole numbers that hold a vector.

    spread numbers the rows of a task, for dealing out rows of one value.
    """
    x = F.col(vector_col)
    fine = (F.size(x) == d) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.coalesce(x.isNotNull() & fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))

    def run(batches):
        at = 0
        for batch in batches:
            with np.errstate(over="ignore"):
                scaled = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * scale)
            over = scaled >= 2.0**63
            z = np.where(over, 0, np.maximum(scaled, -(2.0**63))).astype(np.int64)
            z[over] = MOST
            low, high = z.min(axis=1, initial=0), z.max(axis=1, initial=0)
            width = np.select([(low >= np.iinfo(t).min) & (high <= np.iinfo(t).max) for t in (np.int16, np.int32)], [2, 4], 8)
            packed = [None] * len(z)
            for w in np.unique(width).tolist():
                mine = np.flatnonzero(width == w)
                raw = z[mine].astype(f"<i{w}").tobytes()
                for i, row in enumerate(mine.tolist()):
                    packed[row] = raw[i * w * d : (i + 1) * w * d]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array((np.arange(at, at + len(z)) % (1 << 30)).astype(np.int32))], ["vec_id", "z", "spread"])
            at += len(z)

    return rows.mapInArrow(run, "vec_id long, z binary, spread int")


def unpacked(z: bytes, d: int) -> list[int]:
    return np.frombuffer(z, f"<i{len(z) // d}").tolist()


def _pieces(batch: pa.RecordBatch, d: int):
    """(rows, components int64, weights) of a batch of (z, n), a bounded number of rows of one width at a time."""
    weights, packed = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_pylist()
    widths = np.array([len(z) // d for z in packed])
    for w in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == w)
        for a in range(0, len(mine), PIECE):
            at = mine[a : a + PIECE]
            z = np.frombuffer(b"".join([packed[i] for i in at.tolist()]), f"<i{w}").reshape(-1, d).astype(np.int64)
            yield at, z, weights[at]


def _most(*arrays: np.ndarray) -> int:
    return max(max(-int(a.min()), int(a.max())) if a.size else 0 for a in arrays)


def nearest(z: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of the nearest centroid, the first of equals; centroids: whole numbers of 64 bits."""
    d, reach = z.shape[1], _most(z, centroids)
    if 4 * d * reach * reach < 1 << 53:
        x, c = z.astype(np.float64), centroids.astype(np.float64)
        squares = ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)) - 2 * (x @ c.T)  # all terms are exact
        at = squares.argmin(axis=1)
        return at, squares[np.arange(len(z)), at].astype(np.int64)
    exact = np.int64 if 4 * d * reach * reach < 1 << 63 else object
    x, c = z.astype(exact), centroids.astype(exact)
    squares = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    at = squares.argmin(axis=1) if exact is np.int64 else np.array([min(range(len(c)), key=row.__getitem__) for row in squares.tolist()], np.int64)
    return at, squares[np.arange(len(z)), at]


def _summed(centroids: np.ndarray, d: int):
    """A task's partial sums: per cluster and component the weighted sum, and at component d the weight."""

    def run(batches):
        k = len(centroids)
        totals = np.zeros((k, d + 1), object)
        for batch in batches:
            for _, z, n in _pieces(batch, d):
                at, _ = nearest(z, centroids)
                exact = _most(z) * int(n.astype(object).sum()) < 1 << 62
                weighted = z * n[:, None] if exact else z.astype(object) * n.astype(object)[:, None]
                for c in np.unique(at).tolist():
                    mine = at == c
                    totals[c, :d] += weighted[mine].sum(axis=0).astype(object)
                    totals[c, d] += int(n[mine].sum())
        if totals[:, d].any():
            c, i = np.indices(totals.shape)
            digits = pa.array([str(x) for x in totals.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel().astype(np.int32)), pa.array(i.ravel().astype(np.int32)), digits], ["cluster", "at", "total"])

    return run


def _assigned(centroids: np.ndarray, d: int):
    def run(batches):
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, z, _ in _pieces(batch, d):
                cluster[rows], squares = nearest(z, centroids)
                distance[rows] = np.minimum(squares, MOST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(distance)], ["z", "n", "cluster", "distance"])

    return run


def first_centroids(packed: DataFrame, k: int = K, seed: str = SEED, d: int = DIMENSIONS) -> np.ndarray:
    """The k vectors whose ids hash lowest with the seed, in the order of their hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = packed.where("vec_id IS NOT NULL").select(order.alias("order"), "z").orderBy("order", "z").limit(k).collect()  # k rows
    rows = sorted((r["order"], unpacked(r["z"], d)) for r in least)
    return np.array([z for _, z in rows], np.int64).reshape(-1, d)


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """centroids after so many rounds over (z, n): each the floor of its vectors' weighted mean; empty ones stay."""
    d = centroids.shape[1]
    for _ in range(rounds):
        parts = distinct.mapInArrow(_summed(centroids, d), "cluster int, at int, total string")
        # k * (d + 1) rows, whatever the table holds
        sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        totals = np.zeros((len(centroids), d + 1), object)
        for r in sums:
            totals[r["cluster"], r["at"]] = int(r["total"])
        after = np.array([[int(x) // int(row[d]) for x in row[:d]] if row[d] else old.tolist() for row, old in zip(totals, centroids)], np.int64)
        if (after == centroids).all():
            break  # all further rounds give the same
        centroids = after
    return centroids


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, d: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, id_col="vec_id", vector_col="embedding", hot: int = HOT) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>, multiplicity."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lloyd")
    packed = scratch.table(quantised(vectors, d, scale, id_col, vector_col), "packed")
    centroids = first_centroids(packed, k, seed, d)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>, multiplicity long"
    if not len(centroids):
        return packed.where("false").select(*(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in result.split(", "))))
    distinct = scratch.table(packed.groupBy("z").agg(F.count("*").alias("n")), "distinct")
    centroids = lloyd(distinct, centroids, rounds)
    assigned = scratch.table(distinct.mapInArrow(_assigned(centroids, d), "z binary, n long, cluster int, distance long"), "assigned")
    rows = assigned.agg(F.sum("n")).first()[0]
    weighed = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    sums = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(weighed.alias("inertia")).collect()}  # k rows
    whole = min(sum(sums.values()), MOST)
    per = spark.createDataFrame(
        [(c, min(sums.get(c, 0), MOST), whole, row.tolist()) for c, row in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<bigint>"
    )
    share = max(1, rows // hot)
    few = F.broadcast(assigned.where(F.col("n") > share).select("z", F.ceil(F.col("n") / share).cast("int").alias("salts")))  # at most `hot` rows
    salted = packed.join(few, "z", "left").withColumn("salt", F.coalesce(F.pmod("spread", "salts"), F.lit(0)))
    salts = F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("int")).otherwise(1)
    dealt = assigned.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    back = salted.join(dealt, ["z", "salt"]).join(F.broadcast(per), "cluster")  # k rows
    return back.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", F.col("n").alias("multiplicity"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle(k: int = K, rounds: int = ROUNDS, d: int = DIMENSIONS) -> str:
    """The rounds written out, on rows of (vector, component)."""
    steps = [f"""
z AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {d}),
comp AS MATERIALIZED (SELECT r, unnest(range(1, {d + 1})) AS i, unnest(z) AS x FROM z),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(1, {d + 1})) AS i, unnest(z) AS y FROM (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), z) - 1 AS c, z FROM z WHERE vec_id IS NOT NULL) WHERE c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, CAST(min(struct_pack(d := d, c := c)).c AS INTEGER) AS cluster, min(d) AS distance FROM (
    SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM comp JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(m, y) AS y FROM c{n} LEFT JOIN (
    SELECT cluster AS c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM comp JOIN a{n} USING (r) GROUP BY cluster, i)) USING (c, i))""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN z USING (r) JOIN (SELECT c AS cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (cluster)
"""


ORACLE = _oracle()
