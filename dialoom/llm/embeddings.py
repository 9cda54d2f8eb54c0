"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A vector is rotated by three rounds of random signs and a Walsh-Hadamard transform; a hash is the coordinate of largest
size and its sign. Several of them make a bucket code, in each of several tables; a vector also probes the bucket where
its least certain hash takes its second choice. The number of hashes grows with the logarithm of the number of vectors, so
that buckets stay short, and the number of tables with it, so that recall stays (TABLES). Vectors meet in a bucket if their
labels are equal and one of them has it as its own; their cosine is then computed in double precision.

Only bucket keys and ids are dealt out to find the buckets in which vectors meet; a vector itself is sent only there. Buckets
of more than BLOCK rows are cut into blocks, and each two blocks meet in a task of their own, so a task holds 2 * BLOCK rows
or so at most, whatever the bucket's size.

Pairs never leave a task. A pair counts in the first table where it meets, which its two codes tell, so a task gives sums
of links per vector and, for each vector, one edge within its local class; classes are the connected components of those
edges. Equal vectors are one class member with a count.

Defined results: a vector that is null, zero, or has null or non-finite components, and one whose label is null, has no
links and is its own component; vectors of unequal length never link; rows that repeat a vec_id are one vector if they are
equal, and give one row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.components import connected_components
from dialoom.llm.shared import Scratch, table
from dialoom.llm.shingles import scramble

LEAST_COSINE = 0.98
#: Tables by number of hashes: with them about one pair in 5,000 of cosine 0.98 and 64 to 256 dimensions meets nowhere.
TABLES = {1: 4, 2: 6, 3: 10, 4: 15, 5: 22, 6: 32, 7: 46}
BUCKETS_A_VECTOR = 8
BLOCK = 1500
SHORT = 16
ROUNDS = 3


def usable(vector: Column) -> Column:
    """Not null, not all zero, no null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, n = x.shape
    step = 1
    while step < n:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def codes(unit: np.ndarray, tables: int, hashes: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(own, probe): bucket codes of unit vectors, rows by tables."""
    width = max(2, 1 << (unit.shape[1] - 1).bit_length())
    wide = np.zeros((len(unit), width))
    wide[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, width])
    own, probe = np.zeros((2, len(unit), tables), np.int64)
    every = np.arange(len(unit))
    for t in range(tables):
        first, second, gaps = [], [], []
        for _ in range(hashes):
            y = wide
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            a = size.argmax(axis=1)
            top = size[every, a]
            size[every, a] = -1.0
            b = size.argmax(axis=1)
            first.append(2 * a + (y[every, a] < 0))
            second.append(2 * b + (y[every, b] < 0))
            gaps.append(top - size[every, b])
        least = np.argmin(gaps, axis=0)
        for k in range(hashes):
            own[:, t] = own[:, t] * (2 * width) + first[k]
            probe[:, t] = probe[:, t] * (2 * width) + np.where(least == k, second[k], first[k])
    return own, probe


def _matrix(column) -> np.ndarray:
    """An array column of equal lengths as float64 rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashes_for(vectors: int, width: int) -> int:
    """So many hashes that there are BUCKETS_A_VECTOR buckets or more per vector."""
    h, choices = 1, 2 * max(2, 1 << max(0, width - 1).bit_length())
    while choices**h < BUCKETS_A_VECTOR * vectors and h < max(TABLES) and choices ** (h + 1) < 1 << 62:
        h += 1
    return h


def _by_length(column):
    """(which rows, their unit vectors) for each length of vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, _unit(_matrix(column if len(at) == len(lengths) else column.take(pa.array(at))))


def _bucket_keys(tables, hashes):
    """(rep, label, embedding) -> rep, keys: bucket 2 t is a vector's own in table t, bucket 2 t + 1 its probe."""

    def run(batches):
        for batch in batches:
            keys = np.zeros((batch.num_rows, 2 * tables), np.uint64)
            label = batch.column("label").to_numpy().astype(np.uint64)
            for at, unit in _by_length(batch.column("embedding")):
                own, probe = codes(unit, tables, hashes)
                for t in range(tables):
                    place = scramble(label[at] + np.uint64((t << 32) + (unit.shape[1] << 40)), 1)
                    for kind, code in ((0, own), (1, probe)):
                        keys[at, 2 * t + kind] = scramble(code[:, t].astype(np.uint64) + place, 2)
            ends = np.arange(0, keys.size + 1, 2 * tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(ends, keys.ravel().view(np.int64))], ["rep", "keys"])

    return run


def _local_first(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's class, when rows i and j are linked."""
    first = np.arange(n)
    while True:
        before = first.copy()
        np.minimum.at(first, i, first[j])
        np.minimum.at(first, j, first[i])
        first = first[first]
        if (first == before).all():
            return first


def _bucket_links(tables, hashes, least):
    def near(unit, starts, sizes, may):
        """Pairs of rows of one length in the same group, of cosine least or more; short groups all at once."""
        group = np.repeat(np.arange(len(starts)), sizes)
        short = np.repeat(sizes <= SHORT, sizes)
        for d in range(1, min(SHORT, len(unit))):
            i = np.flatnonzero((group[:-d] == group[d:]) & short[:-d])
            i = i[may(i, i + d)]
            yield i[hit := np.einsum("ij,ij->i", unit[i], unit[i + d]) >= least], i[hit] + d
        for start, size in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            of = unit[start : start + size]
            for at in range(0, size, 512):
                i, j = np.nonzero(of[at : at + 512] @ of.T >= least)
                i, j = start + at + i, start + j
                i, j = i[i < j], j[i < j]
                ok = may(i, j)
                yield i[ok], j[ok]

    def of_groups(rows: pa.Table):
        rows = rows.combine_chunks()
        rep, slot, copies, label, part, crossing = (rows[c].to_numpy() for c in ("rep", "slot", "copies", "label", "part", "crossing"))
        column = rows["embedding"].chunk(0)
        key = np.stack([rows[c].to_numpy() for c in GROUP])
        found, units = [], np.zeros((len(rep), max(1, int(column.value_lengths().to_numpy(zero_copy_only=False).max()))))
        lengths = np.zeros(len(rep), np.int64)
        for at, unit in _by_length(column):
            starts = np.flatnonzero(np.r_[True, (key[:, at[1:]] != key[:, at[:-1]]).any(axis=0)])

            def may(i, j, at=at):
                i, j = at[i], at[j]
                ok = (rep[i] != rep[j]) & (label[i] == label[j]) & (slot[i] >> 1 == slot[j] >> 1) & ((slot[i] & slot[j] & 1) == 0)
                return ok & ((crossing[i] == 0) | (part[i] != part[j]))

            found += [(at[i], at[j]) for i, j in near(unit, starts, np.diff(np.r_[starts, len(at)]), may)]
            units[at, : unit.shape[1]], lengths[at] = unit, unit.shape[1]
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        i, j = np.where(rep[i] < rep[j], i, j), np.where(rep[i] < rep[j], j, i)
        used, back = np.unique(np.r_[i, j], return_inverse=True)
        own, probe = np.zeros((2, len(used), tables), np.int64)
        for length in np.unique(lengths[used]):
            at = np.flatnonzero(lengths[used] == length)
            own[at], probe[at] = codes(units[used[at], :length], tables, hashes)
        a, b = back[: len(i)], back[len(i) :]
        table = slot[i] >> 1
        meet = (own[a] == own[b]) | (own[a] == probe[b]) | (probe[a] == own[b])
        ok = meet.argmax(axis=1) == table  # else they met in an earlier table
        # in a table they may meet twice, each in the other's probe: then in the first one's own bucket
        row = np.arange(len(i))
        twice = (own[a, table] != own[b, table]) & (own[a, table] == probe[b, table]) & (probe[a, table] == own[b, table])
        ok &= ~(twice & (slot[i] & 1 == 1))
        i, j = i[row[ok]], j[row[ok]]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        linked, first = links > 0, _local_first(i, j, len(rep))
        return pa.RecordBatch.from_arrays(
            [pa.array(rep[linked]), pa.array(links[linked].astype(np.int64)), pa.array(rep[first][linked])], ["rep", "links", "first"]
        )

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            keys = [held[c].to_numpy() for c in GROUP]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(ends):
                if (out := of_groups(held.slice(0, int(ends[-1])))) is not None:
                    yield out
                held = held.slice(int(ends[-1]))
        if held is not None and (out := of_groups(held)) is not None:
            yield out

    return run


#: What a task compares together: a bucket, or two blocks of a bucket.
GROUP = ("key", "low", "high")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, hashes: int | None = None, block: int = BLOCK,
                 id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors; label_col holds integers; hashes: as hashes_for() says, if None."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    good = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # a vec_id under two vectors or labels takes part with each, and a class is named by its least id: so classes have ids of their own
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    hashes = hashes or hashes_for(n, width or 1)
    tables = TABLES[hashes]
    keyed = scratch.table(classes.select("rep", "label", "embedding").mapInArrow(_bucket_keys(tables, hashes), "rep long, keys array<long>"), "keys")
    rows = keyed.select("rep", F.posexplode("keys").alias("slot", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.col("slot") % 2).alias("kind")).where("size > 1 AND kind = 0").select("key", "size")
    rows = scratch.table(rows.join(shared, "key"), "met")
    scratch.drop(keyed)
    rows = rows.withColumn("parts", F.ceil(F.col("size") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other"), })
    rows = rows.withColumn("crossing", (F.col("low") != F.col("high")).cast("int")).select(*GROUP, "slot", "rep", "part", "crossing")
    rows = rows.join(classes.select("rep", "label", "copies", "embedding"), "rep")
    linked = rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_bucket_links(tables, hashes, least), "rep long, links long, first long")
    linked = scratch.table(linked, "links")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    ids = classes.select("rep", "least")
    edges = linked.select("rep", "first").join(ids, "rep").select("first", F.col("least").alias("u")).join(ids, F.col("first") == F.col("rep")).select("u", F.col("least").alias("v"))
    components = connected_components(scratch, edges)
    named = classes.join(counts, "rep", "left").join(components, F.col("least") == F.col("node"), "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    of_good = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_good.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
