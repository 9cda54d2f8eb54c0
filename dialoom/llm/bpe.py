"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols sit at the leaves of a segment tree whose keys are (rank of the pair with the next symbol, position); the
root is the leftmost lowest-rank merge. A merge changes at most three leaves, each in logarithmic time, so a word of n
symbols takes O(n log n) however long it is. Words repeat, so each worker keeps a bounded memo of encoded words.

The vocabulary file is of fixed size, read once by the driver and broadcast. Texts are normalised, cut into words and
mapped to byte symbols as that file says: NFC, white space runs to one space, lower case letter by letter; the file's
split pattern; byte symbols with a word-end mark. Special tokens named in the file are cut out of the raw text first.

Batches are coded in slices of bounded bytes, since a slice's decoded texts share one Arrow array.

Defined results: null and empty texts have no tokens and decode to ""; texts are never cut; repeated rows are encoded each
time; an empty table gives no rows; a column with a clashing name is not read unless asked for.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.shared import slices, table

MEMO_WORDS = 400_000
NO_PAIR = 1 << 62


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the rest are shifted above U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, shifted = [""] * 256, 0
    for b in range(256):
        if b in own:
            table[b] = chr(b)
        else:
            table[b], shifted = chr(256 + shifted), shifted + 1
    return table


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """symbols merged until no mergeable pair remains; merges: pair -> (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    find, sym = merges.get, list(symbols)
    for i in range(n - 1):
        if pair := find((sym[i], sym[i + 1])):
            tree[size + i] = pair[0] * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    def rank(i: int) -> int:
        j = after[i]
        pair = find((sym[i], sym[j])) if j < n else None
        return pair[0] * n + i if pair else NO_PAIR

    while tree[1] != NO_PAIR:
        i = tree[1] % n
        j = after[i]
        sym[i] = find((sym[i], sym[j]))[1]
        sym[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, NO_PAIR)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    return [s for s in sym if s >= 0]


class WordCoder(dict):
    """word -> its ids as bytes of int32; a memo of MEMO_WORDS words, behind which the last full one is kept."""

    def __init__(self, model: dict):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.older = dict(self)
            self.clear()
        if (ids := self.older.get(word)) is None:
            raw = [self.symbols[b] for b in word.encode("utf-8")]
            raw[-1] += self.end
            ids = np.array(merge_symbols([self.vocab[s] for s in raw], self.merges), np.int32).tobytes()
        if len(ids) <= 256:
            self[word] = ids
        return ids


#: White space, letters and digits below U+0250 as the split pattern has them; texts of other characters take the pattern itself.
SPACE, LETTER = "\\t-\\r \\x85\\xa0", "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORDS = re.compile(rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{SPACE}{LETTER}0-9]+").findall
NOT_PLAIN = re.compile("[^\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]").search


class Tokenizer:
    def __init__(self, spec: dict):
        self.coder = WordCoder(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = {t[0] for t in self.special}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.any_words, self.plain = regex.compile(pattern).findall, pattern == CLIP_PATTERN
        self.tokens = [""] * (1 + max([*self.coder.vocab.values(), *self.special.values()]))
        for token, i in chain(self.coder.vocab.items(), self.special.items()):
            self.tokens[i] = token

    def normalize(self, text: str) -> str:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # white space is never part of a word, so only its presence matters; sigma is lowered without its final form
        return text.replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        text = self.normalize(text)
        return PLAIN_WORDS(text) if self.plain and not NOT_PLAIN(text) else self.any_words(text)

    def encode(self, text: str | None) -> bytes:
        """The ids as bytes of int32."""
        if not text:
            return b""
        if self.cut is None or not any(mark in text for mark in self.marks) or not self.cut.search(text):
            return b"".join(map(self.coder.__getitem__, self.words(text)))
        parts = []
        for part in self.cut.split(text):
            parts.append(np.int32(self.special[part]).tobytes() if part in self.special else b"".join(map(self.coder.__getitem__, self.words(part))))
        return b"".join(parts)

    def encode_ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), np.int32).tolist()

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, Tokenizer] = {}


def load(content: str) -> Tokenizer:
    """One tokenizer per worker and vocabulary, so that its memo lasts from task to task."""
    if content not in _LOADED:
        _LOADED.clear()
        _LOADED[content] = Tokenizer(json.loads(content))
    return _LOADED[content]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def code(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, ids array<int>, decoded string: every text encoded, and its ids decoded again."""
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches):
        tokenizer = load(content.value)
        tokens = pa.array(tokenizer.tokens, pa.string())
        for batch in batches:
            for part in slices(batch, 1):
                coded = [tokenizer.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
                ids = pa.array(np.frombuffer(b"".join(coded), np.int32))
                # decoded from the ids: their tokens, joined by a space
                decoded = pc.binary_join(pa.ListArray.from_arrays(ends, tokens.take(ids)), " ")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, ids), decoded], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = code(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
