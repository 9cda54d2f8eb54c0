"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Candidates are ordered by length, longest first, and packed into chunks; queries likewise, into blocks. Each block first
meets the chunks of the longest vectors, which gives every query a score that its answers cannot be below. Then blocks and
chunks meet, each pair in a task slot of its own, unless the product of lengths already rules the pair out; since both are
sorted by length, a block's longest query speaks for the others. There, piece by piece, the leading coordinates after a
rotation by the singular vectors of all candidates give a partial sum, and the rest is bounded by the product of the residual
lengths; only pairs whose bound reaches the query's score are computed, as whole numbers. Rounding of the bounds is covered by
a margin, so results are exact, ties included.

Chunks and blocks are large and hold their numbers in as few bytes as fit, since what meets is shipped: candidates once per
block of BLOCK queries, queries once per chunk of CHUNK candidates. The rotation needs the d x d second moments only, which is
all that reaches the driver besides counts. No pair of single rows is ever a row of a table: a block and a chunk return k rows
per query at most.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as zero
beyond their end; a candidate with the query's id is left out; rows that repeat a vec_id are candidates each, and queries
each, told apart by no column; with fewer than k candidates all are returned; an empty table gives no rows; a score beyond 64
bits raises OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.shared import Scratch, table

K = 10
CHUNK, BLOCK = 8192, 4096
CHUNK_PIECE, BLOCK_PIECE = 2048, 512
LEADING = 4  # one in so many coordinates makes the partial sum
FIRST_CHUNKS = 2
SCALE = 1024
#: Places for queries in a block.
PLACES = 1 << 20


def whole_numbers(vectors: DataFrame, scale: int = SCALE, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """vec_id, z array<long>: each component as floor(scale * x), of the vectors that take part."""
    x = F.col(vector_col)
    fine = F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    rows = vectors.where(fine & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("z"))


def _matrix(column, d: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def _moments(d):
    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            z = _matrix(batch.column(1), d).astype(np.float64)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["at", "sum"])

    return run


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Orthogonal d x d matrix: the right singular vectors of the table, of largest singular value first."""
    sums = rows.mapInArrow(_moments(d), "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).toPandas()
    square = np.zeros(d * d)
    square[sums["at"].to_numpy()] = sums["sum"].to_numpy()
    _, vectors = np.linalg.eigh(square.reshape(d, d))
    return np.ascontiguousarray(vectors[:, ::-1])


def _narrow(z: np.ndarray) -> np.ndarray:
    """z in the narrowest of 16, 32 and 64 bits that holds it."""
    low, high = z.min(initial=0), z.max(initial=0)
    return z.astype(next(f for f in (np.int16, np.int32, np.int64) if np.iinfo(f).min <= low and high <= np.iinfo(f).max))


def _pack(d, size):
    """Rows in order -> pieces (ids, z, width in bytes, longest) of so many rows, never across tasks."""

    def one(rows: pa.Table):
        z = _narrow(_matrix(rows["z"].combine_chunks(), d))
        longest = float(np.linalg.norm(z.astype(np.float64), axis=1).max())
        ids = rows["vec_id"].to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(z).tobytes()], pa.binary()), pa.array([z.itemsize], pa.int32()), pa.array([longest])],
            ["ids", "z", "width", "longest"],
        )

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows >= size:
                yield one(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield one(held)

    return run


PACKED = "ids binary, z binary, width int, longest double"


def _unpacked(ids: bytes, z: bytes, width: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(z, f"i{width}").reshape(-1, d)


def _best(ids, scores, own, k):
    """Places of the k best: by score, then smaller id; never the query's own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > 4 * k:
        floor = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= floor]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _exact(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """c @ q in whole numbers, by floats where these are exact."""
    most = float(np.abs(c.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * c.shape[1]
    if most < 2.0**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return c.astype(np.int64) @ q.astype(np.int64)
    found = c.astype(object) @ q.astype(object)
    if any(abs(x) >= 1 << 63 for x in found):
        raise OverflowError("an inner product does not fit in 64 bits")
    return found.astype(np.int64)


def _meet(d, k, turn):
    lead = max(1, d // LEADING)

    def turned(z):
        x = z.astype(np.float64) @ turn
        return x[:, :lead], np.linalg.norm(x[:, lead:], axis=1), np.linalg.norm(x, axis=1)

    def pair(q_ids, q_at, floor, q, q_turned, c_ids, c, c_turned):
        (q_lead, q_left, q_long), (c_lead, c_left, c_long) = q_turned, c_turned
        may = q_lead @ c_lead.T + np.outer(q_left, c_left) + 1e-9 * np.outer(q_long, c_long) + 1e-6 >= floor[:, None]
        out = []
        for i in np.flatnonzero(may.any(axis=1)):
            at = np.flatnonzero(may[i])
            scores = _exact(c[at], q[i])
            at, scores = at[ok := scores >= floor[i]], scores[ok]
            best = _best(c_ids[at], scores, q_ids[i], k)
            out.append((np.full(len(best), q_ids[i]), np.full(len(best), q_at[i]), c_ids[at[best]], scores[best]))
        return out

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _unpacked(row["q_ids"], row["q"], row["q_width"], d)
                c_ids, c = _unpacked(row["ids"], row["z"], row["width"], d)
                floor, q_at = np.full(len(q_ids), -np.inf), row["block"] * PLACES + np.arange(len(q_ids))
                for f in row["floors"] or []:
                    floor[f["query_at"] % PLACES] = f["floor"]
                for a in range(0, len(c_ids), CHUNK_PIECE):
                    there = slice(a, a + CHUNK_PIECE)
                    c_turned, out = turned(c[there]), []
                    for b in range(0, len(q_ids), BLOCK_PIECE):
                        here = slice(b, b + BLOCK_PIECE)
                        out += pair(q_ids[here], q_at[here], floor[here], q[here], turned(q[here]), c_ids[there], c[there], c_turned)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "query_at", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """rows and queries: (vec_id, z) -> query_id, rank, vec_id, score: the k best of rows for each of queries."""
    scratch = Scratch(rows.sparkSession, "topk")
    squares = F.aggregate("z", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = scratch.table(rows.withColumn("size", squares), "rows")
    d = max(1, rows.agg(F.max(F.size("z"))).first()[0] or 1)
    turn = rotation(rows, d)
    def packed(of: DataFrame, size: int, name: str) -> DataFrame:
        """Pieces of rows, longest first, numbered from 0."""
        ordered = of.repartitionByRange(F.col("size").desc(), "vec_id").sortWithinPartitions(F.col("size").desc()).select("vec_id", "z")
        pieces = scratch.table(ordered.mapInArrow(_pack(d, size), PACKED).withColumn("at", F.monotonically_increasing_id()), name)
        numbered = pieces.select("at", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias(name))  # one short row per piece
        return pieces.join(numbered, "at").drop("at")

    chunks = packed(rows, CHUNK, "chunk")
    blocks = packed(queries.withColumn("size", squares), BLOCK, "block").select(
        "block", F.col("ids").alias("q_ids"), F.col("z").alias("q"), F.col("width").alias("q_width"), F.col("longest").alias("q_longest")
    )
    n_blocks = blocks.count()
    if not n_blocks:
        return queries.limit(0).select(*(F.lit(0).cast(t).alias(c) for c, t in (("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "long"))))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")

    def met(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        both = pairs.join(blocks, "block").join(chunks.drop("longest"), "chunk")
        both = both.select("block", "q_ids", "q", "q_width", "floors", "ids", "z", "width")
        return both.mapInArrow(_meet(d, k, turn), "query_id long, query_at long, vec_id long, score long")

    # the longest candidates first: two chunks are two rows, however long the table
    first = chunks.select("chunk", "longest").orderBy(F.col("longest").desc(), "chunk").limit(FIRST_CHUNKS).select("chunk", every_block)
    no_floor = F.lit(None).cast("array<struct<query_at:bigint,floor:bigint>>")
    scores = met(first, blocks.withColumn("floors", no_floor)).groupBy("query_at").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    floors = scores.where(F.size("scores") >= k).select("query_at", F.col("scores")[k - 1].alias("floor"))
    floors = floors.groupBy(F.floor(F.col("query_at") / PLACES).alias("block")).agg(
        F.collect_list(F.struct("query_at", "floor")).alias("floors"), F.min("floor").alias("least"), F.count("*").alias("known")
    )
    floors = scratch.table(floors, "floors")
    bounded = blocks.join(floors, "block", "left")
    # what no query of a block can want need not meet it
    least = F.when(F.col("known") * 8 == F.length("q_ids"), F.col("least"))
    pairs = chunks.select("chunk", "longest", every_block).join(bounded.select("block", "q_longest", least.alias("least")), "block")
    pairs = pairs.where("least IS NULL OR longest * q_longest * 1.000001 + 1 >= least").select("chunk", "block")
    found = met(pairs, bounded)
    order = Window.partitionBy("query_at", "query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
