"""Cross-tokenizer alignment: where two tokenizers' tokens of one text end together, and which tokens overlap.

Neither tokenizer has a token that goes on from a character other than white space to a blank, so texts are cut into words there,
each with the blanks before it, and a word has the same tokens in every text. Workers put texts into blocks of bounded size and
tokenise a block's different words; Spark intersects the ends of both sides' tokens (array_intersect), which gives the groups. A
second pass numbers the different groups of a block and writes texts as such numbers. All else is Spark's higher-order functions
and joins over different groups, of which there are few, and over texts' numbers.

A group's ends of both sides are sorted together. Of the k-th end, the i-th of its own side, k - i ends of the other side come
before it, which names the two tokens that meet in the piece before it: a piece is a link, and every link is one piece. A text's
groups, links and counts are its groups' in order. Time grows with tokens of different words and with groups (n log n for sorts).

A pair's count is the number of rows that hold it, summed from distinct pairs per row. The pairs that more than one
in HOT of all such rows has are HOT at most, so their counts are sent to the tasks; rare pairs meet their counts by shuffle,
where no pair has more rows than it has texts. What is sent for the best pair of an id is bounded by the vocabulary.

Defined results: a null or empty text, or one whose joined token bytes on either side are not those of a blank and the text, has
no tokens: zeros, no groups; texts are never cut; rows that repeat an id are documents each; an empty table gives no rows; no
column but the id and the text is read.
"""

from __future__ import annotations

import json
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.bpe import byte_symbols
from dialoom.llm.shared import Scratch, slices, table

#: Pairs that more than one in so many (row, pair) has are counted by a list sent to the tasks.
HOT = 1 << 16
#: Ids are below 2**ID_BITS on either side, so that a pair is one whole number.
ID_BITS = 24
#: Texts and bytes of a block at most (a longer text is a block of its own), and words that are tokenised in one call.
BLOCK_ROWS, BLOCK_BYTES, CALL_WORDS = 4096, 1 << 21, 256
#: Words whose tokens a worker keeps from block to block, before it starts anew.
MEMO_WORDS = 200_000
#: Readers take up to a row group's rows at once, so that a block is a row group of its own.
ONE_ROW = {"parquet.block.row.count.limit": "1"}
SIDES = ["a_ids", "a_ends", "b_ids", "b_ends"]
#: Which side's an id is, where ids of both follow each other.
SIDE_B = 1 << ID_BITS

#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A blank after what is not white space, and before blanks and what is not; texts where words are not simply between single blanks.
CUT = re.compile(r"(?<=\S)(?= +\S)")
UNEVEN = re.compile(r"^ |\s(?: |$)").search

_LOADED: dict = {}


def cut_words(text: str | None) -> list[str]:
    """The words of a blank and the text, each without its first blank."""
    if not text:
        return []
    return [w[1:] for w in CUT.split(" " + text)] if UNEVEN(text) else text.split(" ")


class _Numbers(dict):
    """word -> its number from 0; new holds the words that were first met since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Sides:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        import tiktoken

        stands = {c: i for i, c in enumerate(byte_symbols())}
        spec = json.loads(a)
        special = {t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(stands[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in special}
        # such a vocabulary numbers tokens in the order in which they were merged
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.a_bytes[i] = t
        single = re.compile("<0x([0-9A-F]{2})>").fullmatch
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(hit[1], 16)]) if (hit := single(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.sizes = [np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes)]
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers()
        self.memo = [(np.zeros(0, np.int32), np.zeros(0, np.int64)) for _ in range(2)]  # ids, and tokens per word

    def _call(self, words: list[str]) -> tuple | None:
        """(ids, tokens per word) per side of words that blanks join; None where a side's bytes or words differ."""
        raws = [b" " + w.encode() for w in words]
        raw, text, ends = b"".join(raws), " ".join(words), np.cumsum([len(r) for r in raws])
        out = []
        for ids, names, sizes in zip((self.a.encode_ordinary(" " + text), self.b.encode(text)), (self.a_bytes, self.b_bytes), self.sizes):
            if b"".join(map(names.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, np.int32)
            at = np.cumsum(sizes[ids])
            last = np.searchsorted(at, ends, "right")
            if not (at[last - 1] == ends).all():
                return None
            out.append((ids, np.diff(last, prepend=0)))
        return out

    def encode(self, words: list[str]) -> list:
        """(ids, tokens per word) per side; words without tokens where either side's bytes differ."""
        found, even = [], iter([i for i, w in enumerate(words) if w and not w[-1].isspace()])
        while some := list(islice(even, CALL_WORDS)):
            found.append((some, self._call([words[i] for i in some])))
        alone = [i for some, made in found if made is None for i in some] + [i for i, w in enumerate(words) if not w or w[-1].isspace()]
        none = (np.zeros(0, np.int32), np.zeros(1, np.int64))
        found = [x for x in found if x[1] is not None] + [([i], self._call([words[i]]) or (none, none)) for i in alone]
        order = np.argsort(np.array([i for some, _ in found for i in some], np.int64))
        out = []
        for side in (0, 1):
            ids, n = (np.concatenate([none[k][:0], *(made[side][k] for _, made in found)]) for k in (0, 1))
            out.append((ids[_spans(n, order)], n[order]) if alone else (ids, n))
        return out

    def block(self, texts: list[str | None]) -> list[pa.Array]:
        """Texts as numbers of their different words, the words' byte ends one after another, and ids and byte ends of either side."""
        if len(self.known) > MEMO_WORDS:
            self.forget()
        cut = [cut_words(t) for t in texts]
        sizes = np.array([len(words) for words in cut])
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int32, sizes.sum())
        if self.known.new:
            made = self.encode(self.known.new)
            self.known.new = []
            self.memo = [tuple(map(np.concatenate, zip(old, new))) for old, new in zip(self.memo, made)]
        lacking = self.memo[0][1] == 0
        if lacking.any():  # texts with such a word have no tokens
            text = np.repeat(np.arange(len(cut)), sizes)
            bad = np.zeros(len(cut), bool)
            bad[text[lacking[codes]]] = True
            codes, sizes = codes[~bad[text]], np.where(bad, 0, sizes)
        del cut
        held = np.zeros(len(self.known), bool)
        held[codes] = True
        used, codes = np.flatnonzero(held), (np.cumsum(held, dtype=np.int32) - 1)[codes]
        sides = [(ids[_spans(n, used)], n[used]) for ids, n in self.memo]
        ends = [np.cumsum(size[ids], dtype=np.int32) for size, (ids, _) in zip(self.sizes, sides)]
        words = ends[0][np.cumsum(sides[0][1]) - 1]
        return [_lists(codes, sizes), *map(pa.array, (words, sides[0][0], ends[0], sides[1][0], ends[1]))]


def _spans(sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The places of the chosen ones of lists of these sizes that follow each other."""
    first, n = (np.cumsum(sizes) - sizes)[chosen], sizes[chosen]
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), pa.array(values))


def _sides(a: str, b: bytes) -> _Sides:
    if (key := (hash(a), hash(b))) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Sides(a, b)
    return _LOADED[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def tokenised(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """A row per block: start long, doc_ids, codes (each text as places of its words), words (their byte ends) and ids and byte ends of either side.

    A block's different words follow each other, and byte ends count on. Texts count on from start within a block, and the numbers
    tell rows apart; they are stable once written. The two vocabulary files are of fixed size, read by the driver and sent to the workers.
    """
    spark, (a, b) = docs.sparkSession, default_paths()
    with open(a_path or a, encoding="utf-8") as f:
        a = f.read()
    with open(b_path or b, "rb") as f:
        files = spark.sparkContext.broadcast((a, f.read()))

    def run(batches):
        sides, at = _sides(*files.value), 0
        for batch in batches:
            for part in slices(batch, 1, BLOCK_ROWS, BLOCK_BYTES):
                whole = np.array([0, part.num_rows], np.int32)
                columns = [pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x) for x in sides.block(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.ListArray.from_arrays(whole, part.column(0)), *columns], ["start", "doc_ids", "codes", "words", *SIDES])
                at += part.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"start long, doc_ids array<{kind}>, codes array<array<int>>, words array<int>, {' array<int>, '.join(SIDES)} array<int>")
    return rows.withColumn("start", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("start"))


def _grouped(codes: pa.ListArray, words: np.ndarray, sides: list[np.ndarray], both: np.ndarray) -> list[pa.Array]:
    """Texts as numbers of their different groups, which end where tokens of both sides do, and those groups' ids and ends."""
    a_ids, a_ends, b_ids, b_ends = sides
    at = [np.searchsorted(both, x) for x in (a_ends, b_ends)]  # the group of each token
    n_a, n_b = (np.bincount(x, minlength=len(both)) for x in at)
    through_a, through_b = np.cumsum(n_a), np.cumsum(n_b)
    ids = np.empty(len(a_ids) + len(b_ids), np.int32)  # per group its ids of one side, then of the other
    ids[np.arange(len(a_ids)) + (through_b - n_b)[at[0]]] = a_ids
    ids[np.arange(len(b_ids)) + through_a[at[1]]] = b_ids | SIDE_B
    ends = (4 * np.concatenate([[0], through_a + through_b])).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(both), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).dictionary_encode()
    number = coded.indices.to_numpy()
    like = np.empty(len(coded.dictionary), np.int64)
    like[number] = np.arange(len(both))  # one of the groups that are alike
    first = np.concatenate([[0], both[:-1]])[like]
    out = []
    for ids, ends, n in ((a_ids, a_ends, n_a), (b_ids, b_ends, n_b)):
        chosen = _spans(n, like)
        out += [_lists(ids[chosen], n[like]), _lists((ends[chosen] - np.repeat(first, n[like])).astype(np.int32), n[like])]
    held = np.diff(np.searchsorted(both, words) + 1, prepend=0)  # groups of each word
    word = codes.flatten().to_numpy()
    before = np.concatenate([[0], np.cumsum(held[word])])
    return [pa.ListArray.from_arrays(pa.array(before[codes.offsets.to_numpy()].astype(np.int32)), pa.array(number[_spans(held, word)])), *out]


def grouped(tokens: DataFrame) -> DataFrame:
    """start, doc_ids, codes (each text as places of its groups) and, per different group of a block, ids and byte ends of either side."""
    names = ["start", "doc_ids", "codes", *SIDES]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c).slice(k, 1) for c in batch.schema.names}
                flat = {c: row[c].flatten() for c in ("codes", "words", *SIDES, "both")}
                words, *sides, both = (flat[c].to_numpy() for c in ("words", *SIDES, "both"))
                codes = pa.ListArray.from_arrays(pa.array((x := flat["codes"].offsets.to_numpy()) - x[0]), flat["codes"].flatten())
                made = _grouped(codes, words, sides, both)
                whole = [pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x) for x in made]
                yield pa.RecordBatch.from_arrays([row["start"], row["doc_ids"], *whole], names)

    kind = tokens.schema["doc_ids"].dataType.simpleString()
    nested = ", ".join(f"{c} array<array<int>>" for c in names[2:])
    # ends increase on either side, and so do those that both have
    both = F.array_intersect("a_ends", "b_ends").alias("both")
    return tokens.select("start", "doc_ids", "codes", "words", *SIDES, both).mapInArrow(run, f"start long, doc_ids {kind}, {nested}")


def _with(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


# An end is end * 2**32 + side * 2**31 + token; a piece is a * 2**32 + b, of tokens' places in a group.
def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 31) - 1))


def _a(piece: Column) -> Column:
    return F.shiftright(piece, 32).cast("int")


def _b(piece: Column) -> Column:
    return _low(piece).cast("int")


def group_pieces(a_ends: Column, b_ends: Column) -> Column:
    """array<bigint>: the pieces of a group in order, by the byte ends of either side's tokens, which increase and have the last one in common."""
    side = lambda ends, mark: F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), 32) + (i + F.lit(mark << 31)))

    def cut(ends):
        from_a = lambda own, k: F.shiftleft(own, 32) + (k - own)
        from_b = lambda own, k: F.shiftleft(k - own, 32) + own
        piece = lambda x, k: F.when(x.bitwiseAND(F.lit(1 << 31)) == 0, from_a(_low(x), k)).otherwise(from_b(_low(x), k))
        # the last end of one side is the other's as well
        return F.slice(F.transform(ends, piece), 1, F.size(ends) - 1)

    # most groups are of one token on either side
    whole = (F.size(a_ends) == 1) & (F.size(b_ends) == 1)
    return F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(_with(F.sort_array(F.concat(side(a_ends, 0), side(b_ends, 1))), cut))


def group_links() -> Column:
    """array<array<bigint>>: per group of a block, its pieces' ids as a * 2**ID_BITS + b."""
    pair = lambda a, b: F.shiftleft(a.cast("long"), ID_BITS) + b
    of = lambda k: lambda x: pair(F.get(F.get(F.col("a_ids"), k), _a(x)), F.get(F.get(F.col("b_ids"), k), _b(x)))
    return F.transform("pieces", lambda group, k: F.transform(group, of(k)))


def group_texts() -> Column:
    """array<string>: per group of a block 'a1,a2|b1,b2', its ids in order."""
    joined = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    return F.zip_with("a_ids", "b_ids", lambda a, b: F.concat(joined(a), F.lit("|"), joined(b)))


def group_marks() -> Column:
    """array<array<tinyint>>: per group of a block and end of a piece, 1 if only side a has it, 2 if only side b has it, 3 if both do."""
    mark = lambda x, y: F.when(y.isNull(), 3).when(_a(x) < _a(y), 1).otherwise(2).cast("byte")
    return F.transform("pieces", lambda group: F.transform(group, lambda x, k: mark(x, F.get(group, k + 1))))


def by_text(blocks: DataFrame, groups: dict[str, Column], /, **columns) -> DataFrame:
    """row, doc_id and more columns per text of blocks; each column is a function of its groups' places and of groups' columns by name."""
    names = list(groups)

    def texts(values):
        values = {c: values.getField(c) for c in names}
        each = lambda codes, k: F.struct(
            (F.col("start") + k).alias("row"), F.get("doc_ids", k).alias("doc_id"), *(f(codes, values).alias(c) for c, f in columns.items())
        )
        return F.transform("codes", each)

    return blocks.select(F.inline(_with(F.struct(*(c.alias(n) for n, c in groups.items())), texts)))


def _joined(name: str):
    """The groups' arrays of a column, one after another."""
    return lambda codes, values: F.flatten(F.transform(codes, lambda k: F.get(values[name], k)))


def _summed(name: str):
    return lambda codes, values: F.aggregate(codes, F.lit(0).cast("long"), lambda so_far, k: so_far + F.get(values[name], k))


def aligned(docs: DataFrame, scratch: Scratch, a_path: str | None = None, b_path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """The blocks of grouped(), written, with the pieces of each group in place of its ends."""
    blocks = grouped(tokenised(docs, a_path, b_path, id_col, text_col))
    pieces = F.zip_with("a_ends", "b_ends", group_pieces).alias("pieces")
    return scratch.table(blocks.select("start", "doc_ids", "codes", "a_ids", "b_ids", pieces), "blocks", **ONE_ROW)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (n is the highest of the pair's first id)."""
    of = lambda links: F.transform("codes", lambda c: F.array_distinct(F.flatten(F.transform(F.array_distinct(c), lambda k: F.get(links, k)))))
    counts = blocks.select(F.explode(F.flatten(_with(group_links(), of))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", ID_BITS))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # one row per id of the vocabulary
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def scored(blocks: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """row, n_best, count_sum of the texts of blocks that have links."""
    counts = scratch.table(pair_counts(blocks), "counts")
    share = counts.agg(F.greatest(F.lit(1), F.floor(F.sum("n") / hot))).first()[0] or 1
    # at most `hot` pairs are frequent; rare pairs of groups stay rows until their counts come by shuffle
    frequent, rare = F.broadcast(counts.where(F.col("n") > share)), counts.where(F.col("n") <= share)
    links = blocks.select("start", F.posexplode(group_links()).alias("code", "pairs")).select("start", "code", F.explode("pairs").alias("pair"))
    found = links.join(frequent, "pair").unionByName(links.join(frequent.select("pair"), "pair", "left_anti").join(rare, "pair"))
    groups = found.groupBy("start", "code").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    groups = groups.repartition("start").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("code", "n_best", "count_sum"))).alias("groups"))
    groups = scratch.table(groups.select("start", "groups.n_best", "groups.count_sum"), "groups", **ONE_ROW)
    sums = {c: F.col(c) for c in ("n_best", "count_sum")}
    texts = blocks.select("start", "doc_ids", "codes").join(groups, "start")
    return by_text(texts, sums, n_best=_summed("n_best"), count_sum=_summed("count_sum"), n_groups=lambda codes, _: F.size(codes)).where("n_groups > 0").select("row", *sums)


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col="doc_id", text_col="text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(tokens, scores) of every row: row, doc_id, a_ids, b_ids, marks, groups, links; and row, n_best, count_sum of rows with links."""
    scratch = Scratch(docs.sparkSession, "alignment")
    blocks = aligned(docs, scratch, a_path, b_path, id_col, text_col)
    groups = {"a_ids": F.col("a_ids"), "b_ids": F.col("b_ids"), "marks": group_marks(), "links": group_links()}
    texts = lambda codes, values: F.transform(codes, lambda k: F.get(values["groups"], k))
    tokens = by_text(blocks, groups | {"groups": group_texts()}, groups=texts, **{c: _joined(c) for c in groups})
    return tokens, scored(blocks, scratch, hot)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "alignment")
    blocks = aligned(table(spark, sf_dir, "documents"), scratch)
    scores = scored(blocks, scratch)
    sizes = F.zip_with("a_ids", "b_ids", lambda a, b: F.shiftleft(F.size(a).cast("long"), 32) + F.size(b))  # both in one sum
    groups = {"sizes": sizes, "n_links": F.transform("pieces", lambda x: F.size(x)), "texts": group_texts()}
    digest = lambda codes, values: F.when(F.size(codes) > 0, F.sha2(F.array_join(F.transform(codes, lambda k: F.get(values["texts"], k)), ";"), 256)).otherwise("")
    n_groups = lambda codes, _: F.size(codes).cast("long")
    own = by_text(blocks, groups, groups_sha256=digest, n_groups=n_groups, **{c: _summed(c) for c in ("sizes", "n_links")})
    own = own.withColumns({"doc_id": F.col("doc_id").cast("long"), "n_a": F.shiftright("sizes", 32), "n_b": F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1))})
    none = {c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}
    return own.join(scores, "row", "left").withColumns(none).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
