"""Language-model scoring: interpolated modified Kneser-Ney, counted in Spark, looked up in memory-mapped sorted hash arrays.

Counting. One pass counts words. A word's id is its place in its shard by falling count, times the number of shards, plus the
shard: frequent words have small ids, which pack well. A second pass counts n-grams of the highest order, as ids. Each task
sums what it has before the shuffle. What is dealt out is packed: sorted, the first column as differences, bytes of equal
weight side by side, compressed; ids and counts are whole.

N-grams of three words go to the shard of their context, so a context's sums are complete where it lies. A context whose words
all occur COMMON times or more may be hot: such n-grams go to the shard of the whole n-gram instead and send partial sums of
their contexts on. Which way an n-gram goes depends on the counts of its context's words only, so every task decides alike,
and no shard holds more than COMMON rows or so of any one context. Suffixes go on as counts of the next lower order: how many
different words stand before them, or, at the beginning of a text, how often they stand there. Nothing is pruned.

A shard's file is a sorted hash array: buckets of about BUCKET entries, found by a table of their starts, with 32 further bits of
the hash per entry; an absent n-gram is taken for another one about once in 2**32 / BUCKET look-ups, whatever the model's size.
Counts take a byte, large ones stand in a list behind. Contexts that occurred once are not stored: their n-gram in the next
lower order tells that they occurred. Counts of single words and of contexts of one word are arrays by id.

Scoring. Workers map the files and look up each batch's n-grams in the order of the files.
p(w | context) = (max(c - D(c), 0) + g * p(w | shorter context)) / sum of c, where g is the context's share of the discounts D1,
D2, D3 for counts of 1, 2 and more, down to single words, which are interpolated with one over vocabulary size plus one.
Discounts come from the counts of counts of each order; where these are too few, they are 0.5, 1 and 1.5.

Files lie in the shared folder, under their final name only when complete, so repeated tasks write the same file again. A
folder that is not a local path is read through pyarrow's file systems into a worker's temporary copies, as they are needed.

Only counts per shard and order reach the driver. Defined results: null and empty texts are one end token; words are never
cut, texts never shortened; a null id is learned from and not held out; repeated rows count each time and are scored each
time; an empty table gives no rows, and a model of no texts gives every token the probability 1; other columns are not read.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.shared import Scratch, shuffles_dropped, slices, table
from dialoom.llm.shingles import _odd, scramble, word_hashes

ORDER = 3
TOKENS_AT_ONCE = 1 << 21
TOKENS_A_SHARD = 2_000_000
COMMON = 500_000
SCORED_AT_ONCE = 1 << 18
BUCKET = 16
FALLBACK = (0.5, 1.0, 1.5)
_U = np.uint64
_END = scramble(np.array([0x656E64], np.uint64), 11)[0]
_ODD = _odd(16)
LARGE = 255
#: Kinds of rows that are dealt out: n-grams, n-grams whose context is split, partial sums of contexts, and figures for the driver.
GRAM, SPLIT, CONTEXT, FIGURES = range(4)
ROWS = "kind int, level int, shard int, keys binary, counts binary"


def mix(ids: np.ndarray) -> np.ndarray:
    """One hash per row of word ids."""
    total = np.full(len(ids), _U(ids.shape[1]))
    for k in range(ids.shape[1]):
        total += (ids[:, k].astype(np.uint64) + _U(1)) * _ODD[k]
    return scramble(total, 12)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def _small(numbers: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counts as a byte each; LARGE and above as places and values."""
    flat = np.ascontiguousarray(numbers, np.uint64).ravel()
    large = np.flatnonzero(flat >= LARGE)
    return np.minimum(flat, LARGE).astype(np.uint8).tobytes(), large.astype(np.uint64).tobytes(), flat[large].tobytes()


class _File:
    """A mapped file: a head of (entries, columns, large counts, buckets, bytes of keys), keys, bucket starts, counts, large counts."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        self.n, self.columns, large, self.buckets, size = whole[:40].view(np.int64).tolist()
        at = 40
        self.keys = whole[at : (at := at + size)]
        self.starts = whole[at : (at := at + 4 * (self.buckets + 1) * (self.buckets > 0))].view(np.uint32)
        self.counts = whole[at : (at := at + self.n * self.columns)].reshape(self.columns, self.n)
        at += -at % 8
        self.places = np.array(whole[at : (at := at + 8 * large)]).view(np.uint64)
        self.values = np.array(whole[at : at + 8 * large]).view(np.uint64)

    def numbers(self, at: np.ndarray) -> np.ndarray:
        """columns x places"""
        found = self.counts[:, at].astype(np.int64)
        if len(self.places):
            row, k = np.nonzero(found == LARGE)
            found[row, k] = self.values[np.searchsorted(self.places, (row * self.n + at[k]).astype(np.uint64))]
        return found

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where absent."""
        bucket, low = _bucketed(keys, self.buckets)
        left, right = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        end = right
        rest = self.keys.view(np.uint32)
        last = self.n - 1
        while (open_ := left < right).any():
            middle = (left + right) >> 1
            less = rest[np.minimum(middle, last)] < low
            left = np.where(open_ & less, middle + 1, left)
            right = np.where(open_ & ~less, middle, right)
        return np.where((left < end) & (rest[np.minimum(left, last)] == low), left, -1)


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    within = scramble(keys, 13)
    return (((within >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64), within.astype(np.uint32)


_MAPS: dict[str, dict] = {}


class Arrays:
    """Files of a model in a folder, by kind and shard; `there` says which shards of a kind have one."""

    def __init__(self, root: str, there: dict[str, bytes] | None = None):
        self.root, self.there = root, there or {}

    def __reduce__(self):
        return Arrays, (self.root, self.there)

    def _fs(self):
        return pafs.FileSystem.from_uri(self.root)

    def _write(self, kind: str, shard: int, head: tuple[int, ...], *parts: bytes) -> None:
        fs, folder = self._fs()
        fs.create_dir(folder, recursive=True)
        name, part = f"{folder}/{kind}-{shard}", f"{folder}/.{kind}-{shard}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for piece in (np.array(head, np.int64).tobytes(), *parts):
                out.write(piece)
        fs.move(part, name)

    def write_hashed(self, kind: str, shard: int, keys: np.ndarray, numbers: np.ndarray) -> None:
        """keys: hashes; numbers: columns x keys."""
        n, buckets = len(keys), max(1, len(keys) // BUCKET)
        bucket, low = _bucketed(keys, buckets)
        order = np.argsort((bucket.astype(np.uint64) << _U(32)) | low)
        starts = np.zeros(buckets + 1, np.uint32)
        np.cumsum(np.bincount(bucket, minlength=buckets), out=starts[1:])
        counts, places, values = _small(numbers[:, order])
        pad = b"\0" * (-(40 + 4 * n + 4 * (buckets + 1) + len(counts)) % 8)
        self._write(kind, shard, (n, len(numbers), len(places) // 8, buckets, 4 * n), low[order].tobytes(), starts.tobytes(), counts, pad, places, values)

    def write_plain(self, kind: str, shard: int, keys: bytes, numbers: np.ndarray) -> None:
        """keys: as the reader wants them; numbers: columns x places."""
        counts, places, values = _small(numbers)
        pad = b"\0" * (-(40 + len(keys) + len(counts)) % 8)
        self._write(kind, shard, (numbers.shape[1], len(numbers), len(places) // 8, 0, len(keys)), keys, counts, pad, places, values)

    def file(self, kind: str, shard: int) -> _File | None:
        bits = self.there.get(kind, b"")
        if shard >> 3 >= len(bits) or not bits[shard >> 3] >> (shard & 7) & 1:
            return None
        if self.root not in _MAPS:  # the maps of one model at a time stay from task to task
            _MAPS.clear()
            _MAPS[self.root] = {}
        if (at := (kind, shard)) not in (maps := _MAPS[self.root]):
            fs, folder = self._fs()
            path = f"{folder}/{kind}-{shard}"
            if fs.type_name != "local":
                copies = maps.setdefault("copies", tempfile.TemporaryDirectory(prefix="dialoom-"))
                pafs.copy_files(path, local := f"{copies.name}/{kind}-{shard}", source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
                path = local
            maps[at] = _File(path)
        return maps[at]

    def by_shard(self, kind: str, shards: np.ndarray, order: np.ndarray):
        """(file, which of the rows) for each shard that has a file; order sorts the rows by shard."""
        sorted_ = shards[order]
        starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(starts, np.r_[starts[1:], len(order)]):
            if (file := self.file(kind, int(sorted_[a]))) is not None:
                yield file, order[a:b]

    def find(self, kind: str, columns: int, keys: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns x keys numbers, 0 where absent; which are there)"""
        found, there = np.zeros((columns, len(keys)), np.int64), np.zeros(len(keys), bool)
        # in the order of files and of their buckets, so that pages are read once
        order = np.argsort((shards.astype(np.uint64) << _U(40)) | (scramble(keys, 13) >> _U(24)))
        for file, rows in self.by_shard(kind, shards, order):
            at = file.hashed(keys[rows])
            rows, at = rows[at >= 0], at[at >= 0]
            found[:, rows], there[rows] = file.numbers(at), True
        return found, there


def _bits(there: np.ndarray, n: int) -> bytes:
    flags = np.zeros(n, bool)
    flags[there] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _tokens(batches, column: int):
    """(rows of the batch, their tokens' hashes, tokens per row): words, then an end, in slices of about 8 * SCORED_AT_ONCE bytes."""
    for batch in batches:
        for part in slices(batch, column, 1 << 20, 8 * SCORED_AT_ONCE):
            found = [np.append(word_hashes(t), _END) for t in part.column(column).to_pylist()]
            yield part, np.concatenate(found), np.array([len(x) for x in found], np.int64)


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """(rows, width) keys, sorted by the first column, and (columns, rows) counts: what _unpacked() reads."""
    keys = np.array(keys)
    keys[1:, 0] = np.diff(keys[:, 0])
    most, n = int(counts.max(initial=0)), len(keys)
    form = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64
    planes = (np.ascontiguousarray(keys).view(np.uint8).reshape(n, -1), np.ascontiguousarray(counts.T, form).view(np.uint8).reshape(n, -1))
    found = [pa.compress(np.ascontiguousarray(p.T).tobytes(), "zstd", asbytes=True) for p in planes]
    head = np.array([n, keys.itemsize, keys.shape[1], np.dtype(form).itemsize, len(counts)], np.int64).tobytes()
    return head + found[0], found[1]


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """((rows, width) keys, (columns, rows) counts)"""
    n, size, width, bytes_, columns = np.frombuffer(keys[:40], np.int64).tolist()
    forms = (np.dtype(f"u{size}"), size * width, keys[40:]), (np.dtype(f"u{bytes_}"), bytes_ * columns, counts)
    keys, counts = (np.frombuffer(pa.decompress(x, n * w, "zstd", asbytes=True), np.uint8).reshape(w, n).T.copy().view(f) for f, w, x in forms)
    keys[:, 0] = np.cumsum(keys[:, 0], dtype=keys.dtype)
    return keys, counts.T.astype(np.int64)


def _rows(kind: int, level: int, keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int):
    """keys (one row each, sorted) and counts (one column each) as one packed row per shard."""
    order = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.uint32), kind="stable")
    keys, counts = keys[order], counts[:, order]
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    there = np.flatnonzero(bounds[1:] > bounds[:-1])
    cut = [_packed(keys[bounds[s] : bounds[s + 1]], counts[:, bounds[s] : bounds[s + 1]]) for s in there]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(there), kind, np.int32)), pa.array(np.full(len(there), level, np.int32)), pa.array(there.astype(np.int32)),
         pa.array([x for x, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())],
        ["kind", "level", "shard", "keys", "counts"],
    )


def _figures(level: int, shard: int, numbers: list[int]):
    columns = [pa.array([x], pa.int32()) for x in (FIGURES, level, shard)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([b""], pa.binary()), pa.array([np.array(numbers, np.int64).tobytes()], pa.binary())], ["kind", "level", "shard", "keys", "counts"])


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, sums of the columns of counts)."""
    order = np.argsort(keys)
    starts = _starts(sorted_ := keys[order])
    return sorted_[starts], order[starts], np.add.reduceat(counts[:, order], starts, axis=1) if len(starts) else counts[:, :0]


def _row_sums(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ids in order, and sums of the columns of counts."""
    bits = int(ids.max(initial=0)).bit_length() or 1
    if bits * ids.shape[1] > 64:
        order = np.lexsort(ids.T[::-1])
        ids = ids[order]
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if len(ids) else np.zeros(0, np.int64)
        return ids[starts], np.add.reduceat(counts[:, order], starts, axis=1)
    key = np.zeros(len(ids), np.uint64)
    for k in range(ids.shape[1]):
        key = (key << _U(bits)) | ids[:, k].astype(np.uint64)
    _, first, sums = _sums(key, counts)
    return ids[first], sums


def _gathered(rows: list[dict], kind: int, width: int, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    found = [_unpacked(r["keys"], r["counts"]) for r in rows if r["kind"] == kind]
    if not found:
        return np.zeros((0, width), np.uint32), np.zeros((columns, 0), np.int64)
    return np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found], axis=1)


def _dealt(batches):
    """(shard or -1, rows of a shard as dicts, figures to hand on)"""
    rows, figures = [], []
    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (kind == FIGURES).any():
            figures.append(batch.filter(pa.array(kind == FIGURES)))
        rows += batch.filter(pa.array(kind != FIGURES)).to_pylist()
    return rows[0]["shard"] if rows else -1, rows, figures


def _count_words(shards: int):
    def run(batches):
        held: list = []
        sizes = [0, 0]

        def merged():
            return _sums(np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held], axis=1))

        def out(words, counts):
            return _rows(GRAM, 0, words[:, None], counts, shard_of(words, shards), shards)

        fresh: list = []
        for _, tokens, _ in _tokens(batches, 0):
            fresh.append(tokens)
            sizes[0] += len(tokens)
            if sizes[0] >= TOKENS_AT_ONCE:
                words, counts = np.unique(np.concatenate(fresh), return_counts=True)
                held.append((words, counts[None]))
                sizes, fresh = [0, sizes[1] + len(words)], []
                if sizes[1] >= TOKENS_AT_ONCE:
                    words, _, counts = merged()
                    held[:] = [(words, counts)]
                    sizes[1] = len(words)
                    if sizes[1] >= TOKENS_AT_ONCE // 2:
                        yield out(words, counts)
                        held.clear()
                        sizes[1] = 0
        if fresh:
            words, counts = np.unique(np.concatenate(fresh), return_counts=True)
            held.append((words, counts[None]))
        if held:
            words, _, counts = merged()
            yield out(words, counts)

    return run


def _write_words(arrays: Arrays):
    def run(batches):
        shard, rows, _ = _dealt(batches)
        if shard < 0:
            return
        keys, counts = _gathered(rows, GRAM, 1)
        words, _, sums = _sums(keys[:, 0], counts)
        rank = np.empty(len(words), np.uint32)
        rank[np.argsort(-sums[0], kind="stable")] = np.arange(len(words))
        arrays.write_plain("word", shard, words.tobytes() + rank.tobytes(), sums)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(words)]), pa.array([int(sums.sum())])], ["shard", "n", "total"])

    return run


class Vocabulary:
    """Ids of words: place by falling count in the shard, times `shards`, plus the shard. `start` is the id of a text's beginning, start + 1 of all unknown words."""

    def __init__(self, arrays: Arrays, shards: int, size: int, longest: int):
        self.arrays, self.shards, self.size, self.start = arrays, shards, size, longest * shards
        self.form = np.uint32 if self.start + 1 < 1 << 32 else np.uint64

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct hashes in order."""
        ids, counts = np.full(len(words), self.start + 1, self.form), np.zeros(len(words), np.int64)
        for file, rows in self.arrays.by_shard("word", shard := shard_of(words, self.shards), np.arange(len(words))):
            there = file.keys[: 8 * file.n].view(np.uint64)
            at = np.minimum(np.searchsorted(there, words[rows]), file.n - 1)
            rows, at = rows[hit := there[at] == words[rows]], at[hit]
            ids[rows] = file.keys[8 * file.n :].view(np.uint32)[at].astype(self.form) * self.form(self.shards) + shard[rows].astype(self.form)
            counts[rows] = file.numbers(at)[0]
        return ids, counts


def windows(ids: np.ndarray, lengths: np.ndarray, order: int, start: int) -> np.ndarray:
    """(order, tokens): each token after the order - 1 ids before it in its text, filled up with the id of the beginning."""
    where = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((order, len(ids)), start, ids.dtype)
    for back in range(order):
        fits = np.flatnonzero(where >= back)
        out[order - 1 - back, fits] = ids[fits - back]
    return out


def _may_be_hot(counts: np.ndarray, common: int) -> np.ndarray:
    """(words of a context, rows) counts -> whether n-grams of the context are dealt by themselves."""
    return counts.min(axis=0) >= common


def _count_grams(vocabulary: Vocabulary, order: int, shards: int, common: int):
    def grams(tokens, lengths):
        words, local = np.unique(tokens, return_inverse=True)
        ids, counts = vocabulary.look_up(words)
        # places in the order of ids, so that sorted n-grams are sorted by ids; the beginning comes last, as it does among ids
        ranked = np.argsort(ids, kind="stable")
        place = np.empty(len(words), np.uint64)
        place[ranked] = np.arange(len(words))
        ids, counts = np.append(ids[ranked], vocabulary.form(vocabulary.start)), np.append(counts[ranked], np.iinfo(np.int64).max)
        columns = windows(place[local], lengths, order, len(words))
        bits = len(words).bit_length()
        if bits * order <= 64:
            key = columns[0]
            for column in columns[1:]:
                key = (key << _U(bits)) | column
            key = np.sort(key)
            starts = _starts(key)
            sums, key = np.diff(np.r_[starts, len(key)]), key[starts]
            columns = np.stack([((key >> _U(bits * (order - 1 - k))) & _U((1 << bits) - 1)) for k in range(order)])
        else:
            rows, sums = _row_sums(columns.T, np.ones((1, columns.shape[1]), np.int64))
            columns, sums = rows.T, sums[0]
        columns = columns.astype(np.int64)
        rows = np.ascontiguousarray(ids[columns].T)
        whole = mix(rows)
        if order == 2:  # contexts of one word are summed by word
            yield _rows(SPLIT, order, rows, sums[None], shard_of(whole, shards), shards)
            return
        split = _may_be_hot(counts[columns[:-1]], common)
        for kind, at, key in ((SPLIT, split, whole), (GRAM, ~split, mix(rows[:, :-1]))):
            if at.any():
                yield _rows(kind, order, rows[at], sums[None, at], shard_of(key[at], shards), shards)

    def run(batches):
        held, sizes, n = [], [], 0
        for _, tokens, lengths in _tokens(batches, 0):
            held.append(tokens)
            sizes.append(lengths)
            if (n := n + len(tokens)) >= TOKENS_AT_ONCE:
                yield from grams(np.concatenate(held), np.concatenate(sizes))
                held, sizes, n = [], [], 0
        if held:
            yield from grams(np.concatenate(held), np.concatenate(sizes))

    return run


def _by_count(sums: np.ndarray) -> np.ndarray:
    """Counts as (sum, ones, twos, more)."""
    return np.stack([sums, sums == 1, sums == 2, sums > 2]).astype(np.int64)


def _count_figures(level: int, shard: int, sums: np.ndarray):
    return _figures(level, shard, [len(sums), int(sums.sum()), *(int((sums == k).sum()) for k in (1, 2, 3, 4))])


def _write_level(arrays: Arrays, level: int, vocabulary: Vocabulary, shards: int):
    """A shard's n-grams of a level, and contexts of the level above: files, rows for the next lower level, and figures."""
    start, words = vocabulary.start, vocabulary.shards

    def run(batches):
        shard, rows, figures = _dealt(batches)
        yield from figures
        if shard < 0:
            return
        keys, counts = _gathered(rows, CONTEXT, 1, 4)
        if len(keys):  # partial sums of contexts of the level above
            keys, _, counts = _sums(keys[:, 0], counts)
            yield from stored(f"split{level + 1}", level + 1, shard, keys, counts)
        parts, found = {}, []
        for kind in (GRAM, SPLIT):
            ids, counts = _gathered(rows, kind, level)
            hashes, first, sums = _sums(mix(ids), counts)
            parts[kind] = ids[first], sums[0]
            found.append((hashes, sums))
        hashes, sums = np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found], axis=1)
        if not len(hashes):
            return
        arrays.write_hashed(f"gram{level}", shard, hashes, sums)
        yield _count_figures(level, shard, sums[0])
        ids, sums = (np.concatenate([parts[k][i] for k in (GRAM, SPLIT)]) for i in (0, 1))
        if level == 2:  # contexts and suffixes are words, and go to their shards
            for kind, column, numbers in ((CONTEXT, 0, _by_count(sums)), (GRAM, 1, np.ones((1, len(ids)), np.int64))):
                key, totals = _row_sums(ids[:, column : column + 1], numbers)
                yield _rows(kind, 1, key, totals, (key[:, 0] % key.dtype.type(words)).astype(np.int64), words)
            return
        home, split = parts[GRAM], parts[SPLIT]
        contexts, _, totals = _sums(mix(home[0][:, :-1]), _by_count(home[1]))
        yield from stored(f"context{level}", level, shard, contexts, totals)
        contexts, _, totals = _sums(mix(split[0][:, :-1]), _by_count(split[1]))
        if len(contexts):
            yield _rows(CONTEXT, level - 1, contexts[:, None], totals, shard_of(contexts, shards), shards)
        before = np.where(ids[:, 1] == start, sums, 1)[None]
        suffixes, totals = _row_sums(ids[:, 1:], before)
        yield _rows(SPLIT, level - 1, suffixes, totals, shard_of(mix(suffixes), shards), shards)

    def stored(kind, level, shard, keys, counts):
        """Contexts that occurred once are left out."""
        kept = counts[0] > 1
        if kept.any():
            arrays.write_hashed(kind, shard, keys[kept], counts[:, kept])
            yield _figures(-level if kind.startswith("split") else -level - 100, shard, [])

    return run


def _write_singles(arrays: Arrays, vocabulary: Vocabulary, sizes: np.ndarray):
    """By word: how many words stand before it, and the sums of it as a context."""

    def run(batches):
        shard, rows, figures = _dealt(batches)
        yield from figures
        if shard < 0:
            return
        numbers = np.zeros((5, int(sizes[shard]) + (shard == 0) * (int(sizes.max()) + 1 - int(sizes[0]))), np.int64)
        for kind, at in ((GRAM, slice(0, 1)), (CONTEXT, slice(1, 5))):
            ids, counts = _gathered(rows, kind, 1, at.stop - at.start)
            ids, _, sums = _sums(ids[:, 0], counts)
            numbers[at, (ids // ids.dtype.type(vocabulary.shards)).astype(np.int64)] = sums
        arrays.write_plain("single", shard, b"", numbers)
        yield _count_figures(1, shard, numbers[0][numbers[0] > 0])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of n-grams of counts 1 to 4."""
    found = FALLBACK
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(k + 1 - (k + 2 if k else 2) * y * n[k + 1] / n[k] if k else 1 - 2 * y * n[1] / n[0] for k in range(3))
        found = d if all(0 < x <= k + 1 for k, x in enumerate(d)) else FALLBACK
    return np.array([0.0, *found])


class Model:
    def __init__(self, vocabulary: Vocabulary, arrays: Arrays, order: int, tokens: int, levels: dict[int, list[int]], shards: int, common: int):
        self.vocabulary, self.arrays, self.order, self.tokens, self.shards, self.common = vocabulary, arrays, order, tokens, shards, common
        self.discounts = {k: discounts(levels[k][2:]) if k in levels else np.zeros(4) for k in range(1, order + 1)}
        n, self.single_total, n1, n2 = (levels.get(1) or [0] * 6)[:4]
        self.single_spare = float(self.discounts[1][1:] @ (n1, n2, n - n1 - n2))

    def _singles(self, ids: np.ndarray) -> np.ndarray:
        """5 x ids numbers of words: as an n-gram, then as a context."""
        asked, back = np.unique(ids, return_inverse=True)
        found, shard = np.zeros((5, len(asked)), np.int64), (asked % asked.dtype.type(self.vocabulary.shards)).astype(np.int64)
        known = asked <= self.vocabulary.start
        place = (asked // asked.dtype.type(self.vocabulary.shards)).astype(np.int64)
        for file, rows in self.arrays.by_shard("single", shard, np.argsort(shard, kind="stable")):
            rows = rows[known[rows] & (place[rows] < file.n)]
            found[:, rows] = file.numbers(place[rows])
        return found[:, back]

    def _shares(self, level: int, count: np.ndarray, sums: np.ndarray, p: np.ndarray) -> np.ndarray:
        d = self.discounts[level]
        kept = np.maximum(count - d[np.minimum(count, 3)], 0)
        return np.where(sums[0] > 0, (kept + (d[1:] @ sums[1:]) * p) / np.maximum(sums[0], 1), p)

    def probabilities(self, grams: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """grams: (order, tokens) ids in the order of texts, counts: of these words; first: where texts begin -> the probability of each last id after the others."""
        singles = self._singles(np.unique(grams[-2:])) if grams.size else np.zeros((5, 0), np.int64)
        place = np.searchsorted(np.unique(grams[-2:]), grams[-2:]) if grams.size else grams[-2:].astype(np.int64)
        d = self.discounts[1]
        one = singles[0][place[1]]
        p = np.full(grams.shape[1], 1 / (self.vocabulary.size + 1))
        if self.single_total:
            p = (np.maximum(one - d[np.minimum(one, 3)], 0) + self.single_spare * p) / self.single_total
        pairs = np.ascontiguousarray(grams[-2:].T)
        two, known = self.arrays.find("gram2", 1, keys := mix(pairs), shard_of(keys, self.shards))
        p = self._shares(2, two[0], singles[1:][:, place[0]], p)
        if self.order == 2:
            return p
        whole, context = mix(np.ascontiguousarray(grams.T)), mix(np.ascontiguousarray(grams[:-1].T))
        split = _may_be_hot(counts[:-1], self.common)
        three, _ = self.arrays.find("gram3", 1, whole, shard_of(np.where(split, whole, context), self.shards))
        sums = np.zeros((4, len(whole)), np.int64)
        # the pair of words before is the pair of the token before; those that occurred once are not stored
        before = np.r_[False, known[:-1]]
        before[first] = self.tokens > 0
        sums[:2, before] = 1
        for kind, at in (("split3", split), ("context3", ~split)):
            rows = np.flatnonzero(at & before)
            found, there = self.arrays.find(kind, 4, context[rows], shard_of(context[rows], self.shards))
            sums[:, rows[there]] = found[:, there]
        return self._shares(3, three[0], sums, p)


def train(docs: DataFrame, order: int = ORDER, text_col="text", tokens_a_shard: int = TOKENS_A_SHARD, common: int = COMMON) -> Model:
    """A model of order 2 or 3 of all rows of docs."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = docs.sparkSession
    root = Scratch(spark, "ngrams").root
    texts = docs.select(F.col(text_col).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = max(least, texts.rdd.getNumPartitions())  # as the input is cut, so are its words
    arrays = Arrays(f"{root}/model")
    counted = texts.mapInArrow(_count_words(words), ROWS).repartitionById(words, F.col("shard"))
    with shuffles_dropped(spark):
        found = counted.mapInArrow(_write_words(arrays), "shard int, n long, total long").collect()  # one row per shard
    sizes = np.zeros(words, np.int64)
    for r in found:
        sizes[r.shard] = r.n
    tokens = sum(r.total for r in found)
    arrays = Arrays(arrays.root, {"word": _bits(np.flatnonzero(sizes), words)})
    vocabulary = Vocabulary(arrays, words, int(sizes.sum()), int(sizes.max()))

    shards = max(least, -(-tokens // tokens_a_shard))
    rows = texts.mapInArrow(_count_grams(vocabulary, order, shards, common), ROWS)
    for level in range(order, 1, -1):
        rows = rows.repartitionById(shards, F.col("shard")).mapInArrow(_write_level(arrays, level, vocabulary, shards), ROWS)
    rows = rows.repartitionById(max(shards, words), F.col("shard")).mapInArrow(_write_singles(arrays, vocabulary, sizes), ROWS)
    levels: dict[int, np.ndarray] = {}
    there: dict[str, list[int]] = {}
    with shuffles_dropped(spark):
        figures = rows.select("level", "shard", "counts").collect()  # some rows per shard
    for r in figures:
        kind = f"context{-r.level - 100}" if r.level < -100 else f"split{-r.level}" if r.level < 0 else f"gram{r.level}" if r.level > 1 else "single"
        there.setdefault(kind, []).append(r.shard)
        if r.level > 0:
            levels[r.level] = levels.get(r.level, 0) + np.frombuffer(r.counts, np.int64)
    arrays = Arrays(arrays.root, arrays.there | {k: _bits(np.array(v), max(shards, words)) for k, v in there.items()})
    vocabulary.arrays = arrays
    return Model(vocabulary, arrays, order, tokens, {k: v.tolist() for k, v in levels.items()}, shards, common)


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) for every row of docs."""

    def run(batches):
        total, vocabulary = model.tokens + model.vocabulary.size + 1, model.vocabulary
        for part, tokens, lengths in _tokens(batches, 1):
            words, local = np.unique(tokens, return_inverse=True)
            ids, counts = vocabulary.look_up(words)
            ids, counts = np.append(ids, vocabulary.form(vocabulary.start)), np.append(counts, np.iinfo(np.int64).max)
            starts, mine = np.cumsum(lengths) - lengths, counts[local]
            base, logs = np.log10((mine + 1.0) / total), np.empty(len(tokens))
            grams, first = windows(local, lengths, model.order, len(words)), np.zeros(len(tokens), bool)
            first[starts] = True
            for at in range(0, len(tokens), 4 * SCORED_AT_ONCE):
                end = at + 4 * SCORED_AT_ONCE
                begin = max(0, at - 1)  # the token before tells what is known of a context
                piece = grams[:, begin:end]
                logs[at:end] = np.log10(model.probabilities(ids[piece], counts[piece], np.flatnonzero(first[begin:end])))[at - begin :]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lengths), pa.array(np.add.reduceat((mine > 0).astype(np.int64), starts)),
                 pa.array(np.full(len(lengths), model.tokens, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(id_column):
    """Rows that learning never sees: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op9_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
