"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Three base patterns give spans of kinds assign, access and hex. The method adds kind guess: where a credential word is
followed by a value (quoted or bare, also after "is" or "->", with any characters), the value's guess cost is the least
sum over all ways to cut it into words, dates, repeats, keyboard walks and brute-force characters, as log10 of the number
of guesses; values of LEAST_VALUE characters or more at or above `min_guess_log10` are spans, unless a base span covers them.
The minimum is found by dynamic programming over (position, kind of the open piece): walks, repeats and brute force grow by
one character at a fixed price, words and dates jump ahead by a bounded length, so a value of n characters takes time linear
in n. Words are of three to LONGEST_WORD letters; longer runs are made of several.

Words are ranked as guessers try them: COMMON first, then the corpus's own by falling count (word_ranks: counted by Spark over
all whole texts, outside of credential values; up to DICTIONARY of the most frequent ones are sent to all workers, which is how many
words a guesser is thought to try), then words of the text itself, again outside of all credential values. So what a value costs
does not depend on where in a text it stands, and a value never makes itself known.

Texts are scanned whole, in the tasks that read them. Offsets are code points, ends exclusive.
Defined results: null and empty texts have no spans; repeated rows are each scanned; an empty table gives no rows; other
columns are kept by redact() and never read.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.shared import Scratch, slices, table

KINDS = ("assign", "access", "hex", "guess")
MIN_GUESS_LOG10 = 9.0
LEAST_VALUE = 6
DICTIONARY = 50_000
#: Distinct words that a task counts before it hands them on.
WORDS_AT_ONCE = 500_000
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, what may stand between it and its value, and the value: quoted on one line, or up to white space.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|secret|token|api_?key|credential)s?["']?[\x20\t]*(?P<by>:=|=>|->|[:=]|\bis\b)[\x20\t]*"""
    r"""(?:"(?P<q>[^"\r\n]+)"|'(?P<s>[^'\r\n]+)'|`(?P<t>[^`\r\n]+)`|(?P<b>[^\s"'`<>,;]+))""",
    re.I | re.A,
)
WORDS_NEEDED = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "credential")

#: Words that guessers try first, likeliest first.
COMMON = (
    "password", "admin", "welcome", "login", "letmein", "qwerty", "monkey", "dragon", "master", "secret", "sunshine", "princess", "football",
    "baseball", "shadow", "superman", "iloveyou", "trustno", "hello", "freedom", "whatever", "starwars", "summer", "winter", "spring", "autumn",
    "changeme", "default", "guest", "root", "user", "test", "demo", "example", "pass", "token", "api", "key", "placeholder", "none", "null",
    "true", "false", "required", "optional", "string", "value", "your", "here", "insert", "enter", "redacted", "hidden", "unknown", "empty",
)
#: Keyboard rows, alphabet and digits, along which walks go either way.
WALKS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qazwsxedcrfvtgbyhnujmikolp")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)
LEET = str.maketrans("013457@$!", "oieastasi")
NEIGHBOURS = {pair for row in WALKS for a, b in zip(row, row[1:]) for pair in ((a, b), (b, a))}
LONGEST_WORD, PERIODS = 24, (1, 2, 3, 4)


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26 if c.islower() else 30)
    return math.log10(33) if c.isascii() else 2.0


def guess_cost(value: str, words: Mapping[str, int]) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs; words: lower-case word -> rank from 1."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    inf = math.inf
    best = [inf] * (n + 1)  # the least cost with all pieces closed
    best[0] = 0.0
    walk, repeat = inf, [inf] * len(PERIODS)  # the least cost with such a piece open here
    for i in range(n + 1):
        if i:
            c = low[i - 1]
            # pieces that end here or stay open: one more character of a walk, of a repeat, or by brute force
            walk = min(walk + 0.3, best_before + math.log10(len(WALKS) * 12) + 0.3) if i > 1 and (low[i - 2], c) in NEIGHBOURS else inf
            for k, p in enumerate(PERIODS):
                same = i > p and c == low[i - 1 - p]
                repeat[k] = min(repeat[k] + 0.01, best_before + 0.5 + 0.1 * p) if same else inf
            best[i] = min(best[i], best_before + _brute(value[i - 1]), walk, *repeat)
        if i == n:
            break
        best_before = here = best[i]
        for end in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for form, extra in ((low, 0.0), (plain, 0.6)):
                if rank := words.get(form[i:end]):
                    cased = 0.0 if value[i:end].islower() else 0.3 if value[i + 1 : end].islower() or value[i:end].isupper() else 1.0
                    best[end] = min(best[end], here + math.log10(1 + rank) + extra + cased)
        if m := DATE.match(low, i):
            best[m.end()] = min(best[m.end()], here + (2.1 if m.end() - i == 4 else 4.6))
    return best[n]


WORD = re.compile(r"(?<![^\s])[^\W\d_]{3,24}(?=[\s.,;:!?]|$)")


def _needed(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in WORDS_NEEDED)


def credentials(text: str) -> list[tuple[int, int]]:
    """(start, end) of values in credential contexts, without a sentence's full stop or bracket after bare ones."""
    found = []
    if _needed(text):
        for m in CONTEXT.finditer(text):
            start, end = m.span(group := next(g for g in "qstb" if m[g] is not None))
            found.append((start, start + len(m[group].rstrip(".!?)]}:")) if group == "b" else end))
    return found


def plain_words(text: str, values: list[tuple[int, int]]) -> list[str]:
    """The words of three to LONGEST_WORD letters, in lower case, that stand outside of credential values."""
    parts, at = [], 0
    for start, end in values:
        parts.append(text[at:start])
        at = end
    return WORD.findall(" ".join([*parts, text[at:]]).lower())


def word_ranks(docs: DataFrame, size: int = DICTIONARY, text_col="text") -> dict[str, int]:
    """Word -> rank from 1: COMMON, then the words of docs that occur most, ties by code point; of words of one count all or none, `size` at most."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return found

        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    if text:
                        counts.update(plain_words(text, credentials(text)))
                if len(counts) >= WORDS_AT_ONCE:
                    yield out()
        if counts:
            yield out()

    scratch = Scratch(docs.sparkSession, "words")
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.table(counted, "counted")
    # the least count that no more than `size` words have or pass, from the number of words of each count
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") <= size)
    least = least.agg(F.min("n")).first()[0]
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    if least is not None:
        frequent = counted.where(F.col("n") >= least).collect()  # `size` rows at most
        for r in sorted(frequent, key=lambda r: (-r.n, r.word)):
            ranks.setdefault(r.word, len(ranks) + 1)
    scratch.drop(counted)
    return ranks


COMMON_RANKS = {w: i + 1 for i, w in enumerate(COMMON)}


def scan(text: str | None, min_guess_log10: float = MIN_GUESS_LOG10, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then in the order of KINDS; ranks: as word_ranks() gives them, else COMMON."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    values = credentials(text)
    if values or _needed(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, next_base, reached, words = sorted(found), 0, 0, None
    for start, end in values:
        while next_base < len(base) and base[next_base][0] <= start:  # values are in order, so base spans are passed once
            reached = max(reached, base[next_base][2])
            next_base += 1
        if end - start < LEAST_VALUE or end <= reached:
            continue
        if words is None:
            own, ranks = dict.fromkeys(plain_words(text, values)), COMMON_RANKS if ranks is None else ranks
            words = ChainMap({w: len(ranks) + i + 1 for i, w in enumerate(own) if w not in ranks}, ranks)
        if guess_cost(text[start:end], words) >= min_guess_log10:
            found.append((start, 3, end))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find_secrets(docs: DataFrame, min_guess_log10: float = MIN_GUESS_LOG10, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> for every row of docs, with words ranked over docs."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col=text_col))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, min_guess_log10, ranks.value)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = MASK) -> str:
    """text with every stretch of overlapping spans replaced by one mask."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, min_guess_log10: float = MIN_GUESS_LOG10, text_col="text", length_col: str | None = None, mask: str = MASK) -> DataFrame:
    """docs with every secret masked, words ranked over docs; length_col, if given, gets the new number of code points where it was not null."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col=text_col))
    names = docs.columns
    at_text = names.index(text_col)
    at_length = names.index(length_col) if length_col else -1

    def run(batches):
        for batch in batches:
            for part in slices(batch, at_text):
                columns = list(part.columns)
                texts = columns[at_text].to_pylist()
                new = [masked(t, s, mask) if (s := scan(t, min_guess_log10, ranks.value)) else t for t in texts]
                columns[at_text] = pa.array(new, columns[at_text].type)
                if at_length >= 0:
                    was = columns[at_length]
                    columns[at_length] = pa.array([n if a is b or n is None else len(b) for n, a, b in zip(was.to_pylist(), texts, new)], was.type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count("guess"),
    )
