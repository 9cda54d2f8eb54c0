"""Substring dedup: documents parsed into factors of earlier documents (relative Lempel-Ziv), whose words are taken out.

The reference is the whole corpus, indexed in blocks. A task makes a block of the documents it reads, in order of their ids,
and parses each one greedily against those before it: a factor runs on as long as the next window of WIDTH words stands next
in the same reference. The first place of every window of the block then goes to the shard of the index that its second hash
names; a shard holds the windows of all blocks as sorted hashes and answers, for each, which document has it first. Answers are
packed by groups of documents, about as many as shards, and meet their texts as one row per document. So every
document is parsed against every block, while a window that very many documents share reaches its shard once per block, not once
per document. A factor ends where its reference parts from the text; the windows across such a boundary were looked up like
all others, so none is lost. A window within one document is never a factor of that document.

Windows are told apart by 64 bits and by the shard, named by an independent hash: with n windows and s shards n * n / 2**65 / s
false ones are expected, one in some 10**13 windows and 10**6 shards, which is more than 50 TB of text.

Rows that repeat a doc_id are one document: none is a reference for another, and a window is a reference with its smallest id.
Defined results: null and empty texts have no words and give ""; texts under WIDTH words and rows without an id are kept as they
are and are no reference; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.shared import SPACE_CLASS, Scratch, slices, table
from dialoom.llm.shingles import scramble, window_hashes, word_hashes

WIDTH = 13
#: Windows of a block, and bytes of text whose windows a shard of the index holds about.
BLOCK = 1 << 21
SHARD_BYTES = 1 << 24
DEALT = "shard long, doc long, seal long, n int, hashes binary, places binary, docs binary, counts binary, factors binary"
ANSWER = "deal long, doc long, seal long, n int, hashes binary, docs binary, counts binary, factors binary"
FOUND = "doc long, found array<struct<seal:bigint,hashes:binary,factors:binary>>"
_U = np.uint64


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as all of them fit in; their width is the length over their count."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


def _seal(words: np.ndarray) -> int:
    """One number for a text, so that rows with one id are told apart."""
    turns = scramble(words ^ scramble(np.arange(len(words), dtype=np.uint64), 4), 5)
    return int((turns.sum(dtype=np.uint64) + _U(len(words))).astype(np.int64))


def runs(starts: np.ndarray, docs: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Factors (start, words, reference, start there) of one text: windows that follow one another there and in the reference."""
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    new = np.r_[True, (np.diff(starts) != 1) | (np.diff(docs) != 0) | (np.diff(places) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    return np.stack([starts[first], starts[last] - starts[first] + width, docs[first], places[first]], axis=1)


class _Block:
    """Windows of several texts, dealt to shards when it is full."""

    def __init__(self, shards: int, width: int):
        self.shards, self.width, self.n, self.parts = shards, width, 0, []

    def add(self, doc: int, text: str):
        words = word_hashes(text, fold=False)
        seal = _seal(words)
        for at in range(0, len(words) - self.width + 1, BLOCK):
            piece = words[at : at + BLOCK + self.width - 1]
            if self.n and self.n + len(piece) > BLOCK:
                yield from self.dealt()
            self.parts.append((doc, seal, at, piece))
            self.n += len(piece) - self.width + 1

    def dealt(self):
        self.parts.sort(key=lambda p: p[:3])
        hashes = np.concatenate([window_hashes(p[3], self.width) for p in self.parts])
        sizes = np.array([len(p[3]) - self.width + 1 for p in self.parts])
        of = np.repeat(np.arange(len(self.parts)), sizes)
        ids = np.array([p[0] for p in self.parts], np.int64)
        ends = np.cumsum(sizes)
        places = np.arange(len(of)) - (ends - sizes)[of] + np.array([p[2] for p in self.parts])[of]
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        # the greedy parse against the documents of the block that come before
        earlier = first[which]
        known = ids[of[earlier]] < ids[of]
        for k in np.unique(of[known]).tolist():
            here = slice(int(ends[k] - sizes[k]), int(ends[k]))
            at = np.flatnonzero(known[here])
            back = earlier[here][at]
            found = runs(places[here][at], ids[of[back]], places[back], self.width)
            yield self._row(int(_deals(ids[k : k + 1], self.shards)[0]), doc=int(ids[k]), seal=self.parts[k][1], factors=found.tobytes())
        # what is first in the block goes to the index
        at = np.sort(first)
        other = np.concatenate([window_hashes(p[3], self.width, turn=1) for p in self.parts])[at] % _U(self.shards)
        order = np.argsort(other.astype(np.uint16) if self.shards < 1 << 16 else other, kind="stable")
        at, other = at[order], other[order]
        for part in np.split(at, np.flatnonzero(np.diff(other)) + 1):
            shard = int(other[0])
            other = other[len(part) :]
            mine, counts = np.unique(ids[of[part]], return_counts=True)  # in order of ids, as the windows are
            yield self._row(shard, n=len(part), hashes=hashes[part].tobytes(), places=_narrow(places[part]), docs=mine.tobytes(), counts=_narrow(counts))
        self.parts, self.n = [], 0

    @staticmethod
    def _row(shard, **values):
        return (shard, *(values.get(name) for name in ("doc", "seal", "n", "hashes", "places", "docs", "counts", "factors")))


_DEALT = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("seal", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("hashes", "places", "docs", "counts", "factors"))])
_ANSWER = pa.schema([("deal", pa.int64()), ("doc", pa.int64()), ("seal", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("hashes", "docs", "counts", "factors"))])
_FOUND = pa.schema([("doc", pa.int64()), ("found", pa.list_(pa.struct([("seal", pa.int64()), ("hashes", pa.binary()), ("factors", pa.binary())])))])


def _deals(docs: np.ndarray, deals: int) -> np.ndarray:
    """To which of so many groups of documents the answers for ids go."""
    return (scramble(docs.astype(_U), 6) % _U(deals)).astype(np.int64)


def _batches(rows, schema: pa.Schema, size: int = 256):
    """Rows as Arrow batches of so many rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _deal(shards: int, width: int):
    def rows(batches):
        block = _Block(shards, width)
        for batch in batches:
            for part in slices(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield from block.add(doc, text)
        if block.parts:
            yield from block.dealt()

    return lambda batches: _batches(rows(batches), _DEALT)


def _answers(deals: int):
    def run(rows: pa.Table) -> pa.Table:
        """One shard: per group of documents the windows that an earlier document has, with where; factors of blocks as they are."""
        plain = rows.filter(pa.compute.is_valid(rows["factors"])).select(["doc", "seal", "factors"]).to_pylist()
        out = [(int(_deals(np.array([r["doc"]]), deals)[0]), r["doc"], r["seal"], None, None, None, None, r["factors"]) for r in plain]
        held = rows.filter(pa.compute.is_valid(rows["hashes"])).select(["n", "hashes", "places", "docs", "counts"]).to_pylist()
        if held:
            hashes = np.concatenate([np.frombuffer(r["hashes"], _U) for r in held])
            places = np.concatenate([_wide(r["places"], r["n"]) for r in held])
            docs = np.concatenate([np.repeat(d := np.frombuffer(r["docs"], np.int64), _wide(r["counts"], len(d))) for r in held])
            order = np.argsort(hashes, kind="stable")
            sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0]), len(order)])
            at = order[np.repeat(sizes > 1, sizes)]
            sizes = sizes[sizes > 1]
            by = np.lexsort((places[at], docs[at], np.repeat(np.arange(len(sizes)), sizes)))  # only what repeats: its first holder comes first
            at = at[by]
            first = np.repeat(at[np.cumsum(sizes) - sizes], sizes)
            later = docs[at] > docs[first]
            at, first = at[later], first[later]
            deal = _deals(docs[at], deals)
            by = np.lexsort((docs[at], deal))
            at, first, deal = at[by], first[by], deal[by]
            for part, there in zip(*(np.split(x, np.flatnonzero(np.diff(deal)) + 1) for x in (at, first))):
                if len(part):
                    mine, counts = np.unique(docs[part], return_counts=True)  # in order, as the windows are
                    where = np.stack([docs[there], places[there]], axis=1)
                    out.append((int(_deals(mine[:1], deals)[0]), None, None, len(part), hashes[part].tobytes(), mine.tobytes(), _narrow(counts), where.tobytes()))
        return pa.Table.from_batches(list(_batches(out, _ANSWER)), _ANSWER)

    return run


def _gathered(rows: pa.Table) -> pa.Table:
    """One group of documents: per document all that was found for it."""
    found = {}
    for r in rows.filter(pa.compute.is_null(rows["hashes"])).select(["doc", "seal", "factors"]).to_pylist():
        found.setdefault(r["doc"], []).append((r["seal"], None, r["factors"]))
    held = rows.filter(pa.compute.is_valid(rows["hashes"])).select(["hashes", "docs", "counts", "factors"]).to_pylist()
    if held:
        hashes = np.concatenate([np.frombuffer(r["hashes"], _U) for r in held])
        where = np.concatenate([np.frombuffer(r["factors"], np.int64).reshape(-1, 2) for r in held])
        docs = np.concatenate([np.repeat(d := np.frombuffer(r["docs"], np.int64), _wide(r["counts"], len(d))) for r in held])
        del held
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(docs) != 0]), len(docs)].tolist()
        for a, b in zip(edges, edges[1:]):
            found.setdefault(int(docs[a]), []).append((None, hashes[order[a:b]].tobytes(), where[order[a:b]].tobytes()))
    listed = ((doc, [dict(zip(("seal", "hashes", "factors"), f)) for f in mine]) for doc, mine in found.items())
    return pa.Table.from_batches(list(_batches(listed, _FOUND)), _FOUND)


def spans_of(words: np.ndarray, found: list[dict], width: int) -> np.ndarray:
    """Factors of one text, in order, from what blocks and shards have found for its id."""
    hashes = window_hashes(words, width)
    doc, place = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    known, seal = np.zeros(len(hashes), bool), _seal(words)
    answers = [f for f in found if f["hashes"] is not None]
    if answers:
        asked = np.concatenate([np.frombuffer(f["hashes"], _U) for f in answers])
        where = np.concatenate([np.frombuffer(f["factors"], np.int64).reshape(-1, 2) for f in answers])
        order = np.lexsort((where[:, 1], where[:, 0], asked))
        asked, where = asked[order], where[order]
        at = np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)
        known = asked[at] == hashes
        doc[known], place[known] = where[at[known]].T
    for f in found:
        if f["hashes"] is None and f["seal"] == seal:
            for start, n, ref, ref_start in np.frombuffer(f["factors"], np.int64).reshape(-1, 4).tolist():
                here = np.arange(start, start + n - width + 1)
                here = here[~known[here]]  # where both know one, the shard's is the first of all
                known[here], doc[here], place[here] = True, ref, ref_start + here - start
    at = np.flatnonzero(known)
    return runs(at, doc[at], place[at], width)


def covered(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n words the spans cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 0] + spans[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


_SPAN = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("reference", pa.int64()), ("reference_start", pa.int64())])


def _cut(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sizes, removed, kept, spans = [], [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = text.encode().split() if text else []  # bytes are split at the six white space characters
                    mine = spans_of(word_hashes(text, fold=False), found, width) if found else np.zeros((0, 4), np.int64)
                    gone = covered(len(words), mine)
                    sizes.append(len(words))
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join(compress(words, (~gone).tolist()) if removed[-1] else words).decode())
                    spans.append(mine)
                ends = np.cumsum([0, *map(len, spans)], dtype=np.int32)
                flat = np.concatenate(spans)
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], fields=list(_SPAN)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), listed], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col="doc_id", text_col="text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id long, n_words, n_removed, kept (the words left, joined by a space) and spans (start, words, reference, reference_start).

    A span is a factor: words of the text, at least width, that start in the reference, a document with a smaller id, as well.
    Spans may overlap. Which of several references a span has may depend on how rows were dealt out; what is removed does not.
    """
    scratch = Scratch(docs.sparkSession, "factors")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    dealt = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_deal(shards, width), DEALT)
    answers = dealt.groupBy("shard").applyInArrow(_answers(shards), ANSWER)
    found = scratch.table(answers.groupBy("deal").applyInArrow(_gathered, FOUND), "found")
    joined = docs.join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:bigint,words:bigint,reference:bigint,reference_start:bigint>>")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACE_CLASS}]+') AS words FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(words[i:i + {WIDTH - 1}], ' ') AS w FROM split, unnest(range(1, len(words) - {WIDTH - 2})) AS t(i)),
firsts AS (
  SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
hit AS (
  SELECT DISTINCT r, unnest(range(i, i + {WIDTH})) AS i FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id),
gone AS (
  SELECT r, list(i) AS places, count(*) AS n FROM hit GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN gone USING (r)
"""
