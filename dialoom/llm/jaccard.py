"""Exact n-gram Jaccard join by universe-partition pigeonhole, down to connected classes.

Sizes fall into bands of ratio 1.5. Within a band every shingle is hashed into one of m segments; two sets of Jaccard
similarity 0.8 or more differ in at most H = (|x| + |y|) / 9 shingles, so of segments with an allowance v (differences
that a probe of it stands) one must be found as soon as the sum of v + 1 is above H.

* Bands from SMALL shingles on use v = 0: equal segments meet. There are about 15 % more segments than the least number,
  so two similar sets agree in several; each set spends that surplus by cost, on the segments that meet in the longest
  buckets. A set that has too few segments with shingles (which practice never shows) meets the others by its prefix: of
  shingles in one order, two similar sets share one among the first n - ceil(0.8 n) + 1 of either.
* Smaller bands have half as many segments with v = 1: a segment and its one-deletion neighbourhood meet.
* A set also probes the band below, if partners may be there.

Buckets of SHORT rows or fewer give all their pairs. Longer buckets are read as a stream: each row is paired with the
bucket's first, and kept for later. Each document's best-supported pair is verified and linked first, then its pair with
the best-linked document of its long buckets; then all pairs whose ends are still in different classes, among them the
pairs of long buckets across classes, the largest class of a bucket never against itself. There, two sets that agree in no
short bucket must agree in enough long ones: with buckets in one order, the shortest first, their first common bucket must
leave either set as many further rows as it has segments beyond the differences allowed. Buckets in which one class has
CROWD rows or more are taken together by that class: what meets it is held against the class's rows and each other by
sketches in blocks of BLOCK rows, and only pairs that may link become rows; the class's rows are dealt out once for every
BLOCK rows that meet it. Other buckets of more than LONG rows are blocks by themselves. So a large group of copies costs a star, and a
passage in many documents next to nothing, and no pair that may link is dropped.
Parity sketches, which bound the difference from below, rule out most pairs that do not link; verification is exact on
the sets. Exact copies are joined beforehand through a key of the whole set.

Nothing but counts and a Bloom filter of ids, sized by their number up to BLOOM_MOST numbers, and no document data reach the
driver; more ids than such a filter tells apart are joined instead.

Defined results: null texts and texts without words have no shingles, link with nothing and are their own class; texts of
fewer words than the width are one shingle; rows that repeat a doc_id give one row each and are one node, which has the links of all its texts; an empty table
gives no rows; other columns are not read by near_duplicates() and are kept untouched by keep_one().
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.components import connected_components
from dialoom.llm.shared import Scratch, slices, table
from dialoom.llm.shingles import WIDTH, scramble, set_key, shingle_set

SMALL = 64
SHORT = 8
BLOOM_LEAST, BLOOM_MOST = 1 << 12, 1 << 22
ROWS_AT_ONCE = 128
CROWD, BLOCK, LONG = 32, 1024, 256
#: Parts into which the rows of sets with exact copies are dealt.
SALTS = 32
#: Roles of a signature row, added up: a one-deletion variant; a probe of the band below.
DELETION, BELOW = 1, 2
_U = np.uint64


def _band_tops() -> list[int]:
    """The largest size of each band; sizes up to 3 allow no difference and need no band."""
    tops = [3]
    while tops[-1] < 1 << 40:
        top = max(tops[-1] + 1, tops[-1] * 3 // 2)
        tops.append(SMALL - 1 if tops[-1] < SMALL - 1 < top else top)
    return tops


TOPS = _band_tops()


def segments_of(band: int) -> int:
    """Enough for any probe of the band: the largest difference is a quarter of its top, from 1.25 times that size above."""
    most = TOPS[band] // 4 + 1
    return most + most * 3 // 20 + 2 if TOPS[band] >= SMALL else (most + 1) // 2


def _segment_of(shingles: np.ndarray, band: int) -> np.ndarray:
    return (((scramble(shingles + _U(band), 4) >> _U(32)) * _U(segments_of(band))) >> _U(32)).astype(np.int64)


def _totals(where: np.ndarray, marks: np.ndarray, m: int) -> np.ndarray:
    """Sums of 64-bit marks per segment, modulo 2**64, in two exact halves."""
    low = np.bincount(where, (marks & _U(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
    return low + (np.bincount(where, (marks >> _U(32)).astype(np.float64), m).astype(np.uint64) << _U(32))


def _name(band: int, segment: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The signature of a segment's content."""
    return scramble(total + scramble(segment.astype(np.uint64) + _U(band << 32), 6), 7)


def _probe(shingles: np.ndarray, band: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, roles) of all segments of a band that hold shingles, in small bands of all, with their variants."""
    m, where, marks = segments_of(band), _segment_of(shingles, band), scramble(shingles, 5)
    totals = _totals(where, marks, m)
    if TOPS[band] >= SMALL:
        segment = np.flatnonzero(np.bincount(where, minlength=m))
        return _name(band, segment, totals[segment]), np.full(len(segment), below)
    whole, less = _name(band, np.arange(m), totals), _name(band, where, totals[where] - marks)
    return np.r_[whole, less], np.r_[np.full(m, below), np.full(len(less), below + DELETION)]


def _below(n: int, band: int) -> tuple[int, int]:
    """(size, need): the largest size in the band below that may be a partner, and segments to probe; 0 if there is none."""
    low = TOPS[band - 1]
    return (low, (n + low) // 9 + 1) if band > 1 and 5 * low >= 4 * n else (0, 0)


def filled(shingles: np.ndarray) -> tuple[int, int, bool]:
    """(own segments, segments in the band below, too few): of those that hold shingles and meet as a whole; else 0.

    A set with too few for the differences it may have must be held against all sets of fitting size.
    """
    n = len(shingles)
    if n < SMALL:
        return 0, 0, False
    band = bisect_left(TOPS, n)
    own = int(np.count_nonzero(np.bincount(_segment_of(shingles, band))))
    few = own <= (n + min(TOPS[band], n * 5 // 4)) // 9
    low, need = _below(n, band)
    if low < SMALL:
        return own, 0, few
    below = int(np.count_nonzero(np.bincount(_segment_of(shingles, band - 1))))
    return own, below, few or below < need


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, roles) of a set."""
    n = len(shingles)
    if n <= TOPS[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    band = bisect_left(TOPS, n)
    sigs, roles = _probe(shingles, band, 0)
    if _below(n, band)[0]:
        more, their = _probe(shingles, band - 1, BELOW)
        sigs, roles = np.r_[sigs, more], np.r_[roles, their]
    return sigs, roles


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of hashed shingles, about a bit for each: two sketches differ in no more bits than their sets in shingles."""
    size = 1 << max(6, (len(shingles) - 1).bit_length())
    at = (scramble(shingles, 8) & _U(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles in which two sets differ; a longer sketch is folded onto a shorter one."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _arrow(names, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _texts(batches):
    """(doc_id array, texts) in slices; rows without an id are left out."""
    for batch in batches:
        for part in slices(batch, 1, ROWS_AT_ONCE):
            yield part.column(0), part.column(1).to_pylist()


def _sizes(width):
    def run(batches):
        for ids, texts in _texts(batches):
            sets = [shingle_set(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *map(pa.array, ([len(s) for s in sets], [set_key(s) for s in sets])),
                 *(pa.array(x, kind) for x, kind in zip(zip(*map(filled, sets)), (pa.int32(), pa.int32(), pa.bool_()))), pa.array([sketch(s) for s in sets], pa.binary())],
                ["doc", "n", "key", "own", "below", "few", "sketch"],
            )

    return run


def _signature_rows(width):
    def run(batches):
        seen: set[int] = set()  # exact copies within a task give one set of rows
        for ids, texts in _texts(batches):
            out = []
            for doc, text in zip(ids.to_pylist(), texts):
                shingles = shingle_set(text, width)
                if len(shingles) <= TOPS[0] or doc is None or (key := set_key(shingles)) in seen:
                    continue
                seen.add(key)
                sigs, roles = signatures(shingles)
                out.append((sigs.view(np.int64), np.full(len(sigs), doc, np.int64), roles + 4 * len(shingles)))
            if out:
                yield _arrow(["sig", "doc", "nr"], *(np.concatenate(c) for c in zip(*out)))

    return run


def _may_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (n and role in one number) that are not both variants, not both probes of a band below, and of fitting sizes."""
    x, y = a >> 2, b >> 2
    return ((a & b & 3) == 0) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))


def _bucket_pairs(batches):
    """Rows sorted by sig -> kind 0: candidate pairs (a < b, times); kind 1: rows of long buckets (sig, doc, n and role)."""
    names = ["kind", "a", "b", "c"]
    held = np.zeros((3, 0), np.int64)  # the last bucket, still open and short
    star = None  # (sig, doc, nr) of the first row of an open long bucket
    store: list[np.ndarray] = []

    def pairs(rows: np.ndarray, length: np.ndarray):
        for d in range(1, SHORT):
            a, b = rows[:, :-d], rows[:, d:]
            ok = (a[0] == b[0]) & (length[:-d] <= SHORT) & (a[1] != b[1])
            ok[ok] = _may_pair(a[2][ok], b[2][ok])
            if ok.any():
                store.append(np.sort(np.stack([a[1][ok], b[1][ok]]), axis=0))

    def flush():
        if store:
            both, times = np.unique(np.concatenate(store, axis=1), axis=1, return_counts=True)
            store.clear()
            yield _arrow(names, np.zeros(both.shape[1], np.int8), both[0], both[1], times.astype(np.int64))

    def long_rows(rows: np.ndarray, firsts: np.ndarray):
        ok = (rows[1] != firsts[1]) & _may_pair(rows[2], firsts[2])
        if ok.any():
            store.append(np.sort(np.stack([rows[1][ok], firsts[1][ok]]), axis=0))
        return _arrow(names, np.ones(rows.shape[1], np.int8), rows[0], rows[1], rows[2])

    def closed(rows: np.ndarray):
        """Whole buckets."""
        if not rows.shape[1]:
            return
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        counts = np.diff(np.r_[starts, rows.shape[1]])
        length = np.repeat(counts, counts)
        several = length > 1
        first = np.repeat(starts, counts)
        if (big := length > SHORT).any():
            yield long_rows(rows[:, big], rows[:, first[big]])
        kept = rows[:, several & ~big]
        if kept.shape[1]:
            pairs(kept, length[several & ~big])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if not rows.shape[1]:
            continue
        if star is not None:
            cut = int(np.searchsorted(rows[0] != star[0], True)) if rows[0][-1] != star[0] else rows.shape[1]
            if cut:
                yield long_rows(rows[:, :cut], np.repeat(np.array(star)[:, None], cut, axis=1))
            if cut == rows.shape[1]:
                continue
            rows, star = rows[:, cut:], None
        rows = np.concatenate([held, rows], axis=1)
        last = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
        yield from closed(rows[:, :last])
        held = rows[:, last:]
        if held.shape[1] > SHORT:
            star = tuple(held[:, 0])
            yield long_rows(held, np.repeat(held[:, :1], held.shape[1], axis=1))
            held = held[:, :0]
        if sum(s.shape[1] for s in store) > 1 << 18:
            yield from flush()
    yield from closed(held)
    yield from flush()


def _filter_bits(ids: DataFrame, words: int) -> np.ndarray:
    """A Bloom filter over the column doc: it may let others through, which costs time but changes nothing."""
    bit = lambda seed: F.xxhash64("doc", F.lit(seed))
    rows = ids.select(F.explode(F.array(bit(1), bit(2))).alias("h")).select(
        F.pmod("h", F.lit(words)).alias("at"), F.shiftrightunsigned("h", 58).cast("int").alias("by")
    )
    rows = rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, by)")).alias("bits")).toPandas()
    bits = np.zeros(words, np.int64)
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, shingles binary), once per doc, for the docs in ids, and perhaps for others."""
    asked = ids.count()
    rows = docs.where("doc IS NOT NULL").select("doc", "text", F.xxhash64("doc", F.lit(1)).alias("h1"), F.xxhash64("doc", F.lit(2)).alias("h2"))
    words = min(max(BLOOM_LEAST, 1 << max(0, asked // 4 - 1).bit_length()), BLOOM_MOST)  # 16 bits an id or more
    if asked > 16 * BLOOM_MOST:
        rows = rows.join(ids.distinct(), "doc", "left_semi")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(ids, words).tobytes())

    def run(batches):
        table = np.frombuffer(bits.value, np.int64).view(np.uint64)
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for i in (2, 3):
                h = batch.column(i).to_numpy(zero_copy_only=False)
                ok &= (table[h % words] >> (h.view(np.uint64) >> _U(58))) & _U(1) == 1
            rows = batch.filter(pa.array(ok))
            for ids, texts in _texts([rows]):
                yield pa.RecordBatch.from_arrays([ids, pa.array([shingle_set(t, width).tobytes() for t in texts], pa.binary())], ["doc", "shingles"])

    return rows.mapInArrow(run, "doc long, shingles binary").dropDuplicates(["doc"])


def _prefixes(width):
    """(shingle, doc, n): of each set the shingles among which every similar set has one."""

    def run(batches):
        for ids, texts in _texts(batches):
            for doc, text in zip(ids.to_pylist(), texts):
                shingles = shingle_set(text, width)
                n = len(shingles)
                if n and doc is not None:
                    first = shingles[: n - -(-4 * n // 5) + 1].view(np.int64)
                    yield _arrow(["shingle", "doc", "n"], first, np.full(len(first), doc, np.int64), np.full(len(first), n, np.int64))

    return run


def _lost_pairs(docs: DataFrame, full: DataFrame, width: int) -> DataFrame:
    """a, b: pairs of fitting size with a set that has too few segments, by prefixes."""
    prefixes = docs.mapInArrow(_prefixes(width), "shingle long, doc long, n long")
    lost = prefixes.join(full.where("few").select("doc").distinct(), "doc", "left_semi").select("shingle", F.col("doc").alias("a0"), F.col("n").alias("n0"))
    met = lost.join(prefixes, "shingle").where("doc <> a0 AND 5 * least(n, n0) >= 4 * greatest(n, n0)")
    return met.select(F.least("a0", "doc").alias("a"), F.greatest("a0", "doc").alias("b")).distinct()


def _verify(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 80 * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _likely(batches):
    for batch in batches:
        n, n1 = batch.column("n").to_numpy(), batch.column("n1").to_numpy()
        bounds = [least_difference(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(9 * np.array(bounds, np.int64) <= n + n1))


def _links(docs: DataFrame, sized: DataFrame, pairs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: first by sketches, which drop no such pair, then by the sets."""
    left = sized.select(F.col("doc").alias("a"), "n", F.col("sketch").alias("x"))
    right = sized.select(F.col("doc").alias("b"), F.col("n").alias("n1"), F.col("sketch").alias("y"))
    likely = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n", "n1", "x", "y")
    pairs = scratch.table(likely.mapInArrow(_likely, "a long, b long"), "likely")
    sets = scratch.table(_sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc")), width), "sets")
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def _class_of(pairs: DataFrame, classes: DataFrame, column: str, name: str) -> DataFrame:
    """pairs with the class of a document column; documents without a link are their own."""
    named = classes.select(F.col("node").alias(column), F.col("component").alias(name))
    return pairs.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def _mixed_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """sig, doc, n, role, of (class), main (the bucket's largest class), length: rows of long buckets that hold several classes."""
    rows = rows.select(F.col("a").alias("sig"), F.col("b").alias("doc"), F.shiftright("c", 2).alias("n"), F.col("c").bitwiseAND(3).alias("role"))
    rows = _class_of(rows, classes, "doc", "of")
    groups = rows.groupBy("sig", "of").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("sig").agg(F.max_by("of", F.struct("size", "of")).alias("main"), F.max("size").alias("crowd"), F.count("*").alias("classes"), F.sum("size").alias("length")).where("classes > 1")
    return rows.join(mixed.select("sig", "main", "crowd", "length"), "sig")


def _hub_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """For each document the pair with the hub that it meets most often: the document of most links in a bucket of another class."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("degree"))
    known = rows.join(degrees, "doc", "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)), -F.col("doc")))
    hubs = known.groupBy("sig").agg(F.max_by(F.struct("doc", "of", "n", "role"), "rank").alias("hub"))
    met = rows.join(hubs, "sig").where("of <> hub.of AND (role & hub.role) = 0 AND 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    times = met.groupBy("doc", F.col("hub.doc").alias("hub")).agg(F.count("*").alias("times"))
    best = times.groupBy("doc").agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("hub"))
    return best.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()


def _reaching(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """Rows of _mixed_rows() with left and whole; without those that come too late in their set to be a pair's first common bucket.

    left: the place in the set's buckets, longest first; whole: segments of the set in this bucket's band, if they meet as a whole.
    """
    segments = sized.groupBy("doc").agg(F.min("own").alias("own"), F.min("below").alias("below"))
    shortest_first = Window.partitionBy("doc", "role").orderBy(F.desc("length"), F.desc("sig"))
    rows = rows.withColumn("left", F.row_number().over(shortest_first)).join(segments, "doc")
    rows = rows.withColumn("whole", F.when(F.col("role") == 0, F.col("own")).when(F.col("role") == BELOW, F.col("below")).otherwise(0)).drop("own", "below")
    return rows.where("left >= whole - floor((n + floor(5 * n / 4)) / 9)")


def _long_bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of documents in different classes that only buckets of LONG rows or fewer bring together; rows from _reaching()."""
    # two sets agree in all segments but the differing ones
    rows = rows.where((F.col("crowd") < CROWD) & (F.col("length") <= LONG)).drop("length")
    minor = rows.where("of <> main").select("sig", *(F.col(c).alias(f"{c}1") for c in ("doc", "of", "n", "role", "left", "whole")))
    met = minor.join(rows, "sig").where(
        "of <> of1 AND doc <> doc1 AND (role & role1) = 0 AND 5 * least(n, n1) >= 4 * greatest(n, n1)"
        " AND left >= whole - floor((n + n1) / 9) AND left1 >= whole1 - floor((n + n1) / 9)"
    )
    return met.select(F.least("doc", "doc1").alias("a"), F.greatest("doc", "doc1").alias("b")).distinct()


def _block_pairs(batches):
    """Rows (main, low, high, part, doc, of, minor, n, sketch), sorted by group -> the pairs (a, b) of a group that may link.

    Parts are numbered from 0 for minor rows and from -1 down for the main class's, of which no two meet.
    """

    def group(rows: pa.Table):
        doc, of, n, part = (rows[c].to_numpy() for c in ("doc", "of", "n", "part"))
        minor = rows["minor"].to_numpy(zero_copy_only=False)
        crossing = rows["low"][0].as_py() != rows["high"][0].as_py()
        sketches = [np.frombuffer(x, np.uint8) for x in rows["sketch"].to_pylist()]
        size = np.array([len(x) for x in sketches])
        found = []
        for short in np.unique(size):
            mine = np.flatnonzero(size == short)
            mine_bits = np.stack([sketches[i] for i in mine])
            for long in np.unique(size[size >= short]):
                others = np.flatnonzero(size == long)
                bits = np.stack([np.bitwise_xor.reduce(sketches[i].reshape(-1, short), axis=0) for i in others])
                for i, x in zip(mine, mine_bits):
                    ok = (minor[i] | minor[others]) & (of[i] != of[others]) & (5 * np.minimum(n[i], n[others]) >= 4 * np.maximum(n[i], n[others]))
                    ok &= (part[others] != part[i]) if crossing else np.True_
                    at = np.flatnonzero(ok)
                    differ = np.bitwise_count(bits[at] ^ x).sum(axis=1, dtype=np.int64)
                    at = others[at[9 * differ <= n[i] + n[others[at]]]]
                    found.append(np.stack([np.minimum(doc[i], doc[at]), np.maximum(doc[i], doc[at])]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return _arrow(["a", "b"], pairs[0], pairs[1])

    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        keys = [held[c].to_numpy() for c in ("main", "low", "high")]
        bounds = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]
        for start, end in zip(bounds, bounds[1:]):
            yield group(held.slice(start, end - start))
        held = held.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield group(held)


def _crowd_pairs(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Pairs of documents that meet in buckets where one class has CROWD rows or more, or in longer ones than LONG; rows from _reaching()."""
    together = F.when(F.col("crowd") >= CROWD, F.struct(F.lit(0).alias("by"), F.col("main").alias("at"))).when(F.col("length") > LONG, F.struct(F.lit(1).alias("by"), F.col("sig").alias("at")))
    rows = rows.withColumn("together", together).where("together IS NOT NULL")
    rows = rows.select(F.xxhash64("together").alias("main"), "doc", "of", (F.col("of") != F.col("main")).alias("minor")).distinct()
    sizes = rows.groupBy("main").agg(F.count_if("minor").alias("minors"), F.count_if(~F.col("minor")).alias("mains"))
    rows = rows.join(sizes, "main").join(single.select("doc", "n", "sketch"), "doc")
    parts = lambda count: F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK))
    place, upto = lambda count: F.pmod(F.xxhash64("doc"), parts(count)), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    rows = rows.withColumn("part", F.when(F.col("minor"), place("minors")).otherwise(-1 - place("mains")))
    # minor rows meet all parts; rows of the main class the minor ones' parts only
    others = F.when(F.col("minor"), F.concat(upto(parts("minors")), F.transform(upto(parts("mains")), lambda x: -1 - x))).otherwise(upto(parts("minors")))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    rows = rows.select("main", "low", "high", "part", "doc", "of", "minor", "n", "sketch")
    keys = ("main", "low", "high")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_block_pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sized = _sized(docs, width, scratch)
    several = sized.where("n > 0 AND doc IS NOT NULL").groupBy("doc").agg(F.count_distinct("key", "n").alias("sets")).where("sets > 1").select("doc")
    if several.limit(1).count():
        return _joined_apart(docs, scratch.table(several, "several"), width, scratch)
    return _joined(docs, sized, width, scratch)


def _sized(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    return scratch.table(docs.mapInArrow(_sizes(width), "doc long, n long, key long, own int, below int, few boolean, sketch binary"), "sizes")


def _joined_apart(docs: DataFrame, several: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """near_duplicates() where ids in several have several texts: each text is a node, and an id's nodes are then one class.

    A text beside an id's first gets a free number above all ids; they must leave room for as many.
    """
    sha = F.sha2(F.col("text"), 256)
    texts = docs.where("text IS NOT NULL").join(several, "doc", "left_semi").select("doc", sha.alias("sha")).distinct()
    first = texts.groupBy("doc").agg(F.min("sha").alias("first"))
    more = scratch.table(texts.join(first, "doc").where("sha <> first").select("doc", "sha", F.monotonically_increasing_id().alias("k")), "more")
    top, k = docs.agg(F.max("doc")).first()[0], more.agg(F.max("k")).first()[0]
    if k is not None and top + 1 + k >= 1 << 63:
        raise ValueError("repeated ids with different texts need free numbers above the largest id")
    more = more.select("doc", "sha", (F.lit(top + 1).cast("long") + F.col("k")).alias("node"))
    named = docs.withColumn("sha", sha).join(more, ["doc", "sha"], "left").select(F.coalesce("node", "doc").alias("doc"), "text")
    named = scratch.table(named, "named")
    found = scratch.table(_joined(named, _sized(named, width, scratch), width, scratch), "apart")
    links = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).distinct()
    classes = connected_components(scratch, links.unionAll(more.select(F.col("node").alias("u"), F.col("doc").alias("v"))))
    out = _class_of(found.select(F.col("doc_id").alias("doc"), "n_shingles"), classes, "doc", "component_id")
    of = more.select(F.col("node").alias("doc"), F.col("doc").alias("of"))
    return out.join(of, "doc", "left").select(F.coalesce("of", "doc").alias("doc_id"), "n_shingles", "component_id")


def _joined(docs: DataFrame, sized: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """near_duplicates() for ids (doc) with one set each."""
    full = sized.where("n > 0 AND doc IS NOT NULL")
    single = full.dropDuplicates(["doc"])
    # a set's copies may be very many: they are dealt by salt, and the few sets that have copies go to every salt
    copied = full.groupBy("key", "n").agg(F.min("doc").alias("v"), F.max("doc").alias("last")).where("v < last")
    copied = copied.select("key", "n", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = full.select("doc", "key", "n", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("long").alias("salt"))
    copies = salted.join(copied, ["key", "n", "salt"]).where("doc <> v").select(F.col("doc").alias("u"), "v")

    rows = docs.mapInArrow(_signature_rows(width), "sig long, doc long, nr long")
    met = rows.repartition("sig").sortWithinPartitions("sig", "doc").mapInArrow(_bucket_pairs, "kind byte, a long, b long, c long")
    met = scratch.table(met, "met")
    pairs = met.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("times"))
    if full.where("few").limit(1).count():
        pairs = pairs.unionAll(_lost_pairs(docs, full, width).withColumn("times", F.lit(1).cast("long"))).groupBy("a", "b").agg(F.sum("times").alias("times"))
    pairs = scratch.table(pairs, "pairs")

    best = pairs.groupBy(F.col("b").alias("of")).agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("with"))
    best = best.select(F.col("with").alias("a"), F.col("of").alias("b"))
    links = scratch.table(_links(docs, single, best, width, scratch).unionAll(copies.select(F.col("v").alias("a"), F.col("u").alias("b"))), "first")
    classes = connected_components(scratch, links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def with_links(more: DataFrame) -> DataFrame:
        known = classes.select(F.col("node").alias("u"), F.col("component").alias("v"))
        return connected_components(scratch, known.unionAll(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    mixed = scratch.table(_mixed_rows(met.where("kind = 1"), classes), "mixed")
    hubs = scratch.table(_hub_pairs(mixed, links).join(best, ["a", "b"], "left_anti"), "hubs")
    classes = with_links(_links(docs, single, hubs, width, scratch))

    mixed = scratch.table(_mixed_rows(met.where("kind = 1"), classes), "mixed")
    reaching = scratch.table(_reaching(mixed, full), "reaching")
    rest = pairs.select("a", "b").unionAll(_long_bucket_pairs(reaching)).unionAll(_crowd_pairs(reaching, single))
    rest = _class_of(_class_of(rest, classes, "a", "of_a"), classes, "b", "of_b").where("of_a <> of_b")
    rest = scratch.table(rest.select("a", "b").distinct().join(best.unionAll(hubs), ["a", "b"], "left_anti"), "rest")
    classes = with_links(_links(docs, single, rest, width, scratch))
    out = _class_of(sized.select("doc", "n"), classes, "doc", "component_id")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs whose document is its class's first; rows that repeat a doc_id are one document and stay or go together."""
    found = near_duplicates(docs, width, id_col, text_col)
    firsts = found.where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("first_of_class")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(firsts, F.col("row").getField(id_col).eqNullSafe(F.col("first_of_class")), "left_semi").select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
