"""Paragraphs of lines by their text first, and words of one text placed in another."""

from __future__ import annotations

import bisect
import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from dialoom.functions.scalars import let
from dialoom.operators.folding import folded

# Quotation marks, also as they look after a wrong decoding.
OPENING, CLOSING, MARKS = '["â€œ“]', '["â€”]', '["â€œ“”]'


def quote_key(text: Column) -> Column:
    """Lower case, no quotation marks, only a-z, 0-9 and apostrophes."""
    low = F.replace(F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("â€™"), F.lit("'")), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(F.regexp_replace(low, MARKS, ""), "[^a-z0-9']+", " "))


def quote_keys(text: Column) -> Column:
    """The keys of a text's quotations, without empty ones."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s){OPENING}(.+?){CLOSING}"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, quote_key), lambda x: x != ""))


def _near(starts: list, centre: float) -> slice:
    """Where among sorted places that do not overlap the nearest to a centre are."""
    n = bisect.bisect_right(starts, centre)
    return slice(max(0, n - 2), n + 2)


def _placed(doc: object, rows: list[tuple]) -> list[tuple]:
    """Of one document's paragraphs, then lines: (doc, l, long, span_paragraph, rank, distance, idx) of each line."""
    places, units, words = [], {}, {}
    found: dict[str, tuple] = {}
    begin, till, out = [], [], []
    for kind, idx, start, end, text, quoted, l in rows:  # noqa: E741
        if kind == 0:
            for key in quoted or ():
                units.setdefault(key, []).append(len(places))
            for word in set(text.split(" ")):
                words.setdefault(word, []).append(len(places))
            places.append((start, end, idx, f" {text} "))
            begin.append(start)
            till.append(end)
            continue
        centre = (start + end) / 2 if start is not None and end is not None else None
        away = lambda p, c=centre: 0.0 if c is None or p[0] <= c <= p[1] else min(abs(c - p[0]), abs(c - p[1]))
        span = None
        if centre is not None and places:
            first = bisect.bisect_right(till, start)
            span = places[first][2] if first < len(places) and begin[first] < end else min((away(p), p[2]) for p in places[_near(begin, centre)])[1]
        if text and text not in found:
            if text in units:
                rank, at = 0, units[text]
            else:
                rank, at = 1, [n for n in min((words.get(w, ()) for w in text.split(" ")), key=len) if f" {text} " in places[n][3]]
            found[text] = rank, at, [begin[n] for n in at]
        rank, at, starts = found.get(text, (None, (), ()))
        best = None, None, None
        if at:
            near = at if centre is None else at[_near(starts, centre)]
            distance, _, idx = min((away(places[n]), abs(places[n][2] - span) if (span or 0) > 0 else 0, places[n][2]) for n in near)
            best = rank, distance, idx
        out.append((doc, l, len(text) >= 6, span, *best))
    return out


def resolved_lines(lines: DataFrame, paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, l, paragraph, method, confidence, span_paragraph, distance) for lines (doc, l, start, end, text), l being unique in doc.

    A paragraph (doc, idx, start, end, text) that quotes the line goes before one that holds its words, and both before the one
    at its span, the first that the span meets or else the nearest; among equals the nearest to the span's centre. Paragraphs do
    not overlap. A document's paragraphs are one group, in which a line meets those that have the word of its own that the fewest have.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    places = paragraphs.where(F.col(doc).isNotNull()).select(doc, F.lit(0).alias("kind"), F.col("idx").cast("long").alias("idx"), number("start"), number("end"), quote_key(F.col("text")).alias("text"), quote_keys(F.col("text")).alias("units"), none(lines.schema["l"].dataType, "l"))
    asked = lines.select(doc, F.lit(1).alias("kind"), none("long", "idx"), number("start"), number("end"), quote_key(F.col("text")).alias("text"), none("array<string>", "units"), "l")
    fields = ("long", BooleanType()), ("span_paragraph", LongType()), ("rank", IntegerType()), ("distance", DoubleType()), ("idx", LongType())
    kind = StructType([lines.schema[doc], lines.schema["l"], *(StructField(*f) for f in fields)])
    rows = folded(places.unionByName(asked), doc, ["kind", "start", "idx"], _placed, kind)
    found, by_span = F.col("rank").isNotNull(), F.col("span_paragraph").isNotNull()
    moved = F.when(F.col("idx") != F.col("span_paragraph"), "_span_corrected").otherwise("")
    method = F.when(F.col("rank") == 0, F.concat(F.lit("quote_unit"), moved)).when(F.col("rank") == 1, F.concat(F.lit("quote_text"), moved)).when(by_span, "span_fallback").otherwise("unresolved")
    sure = F.when((F.col("rank") == 0) | F.col("long") & found, 1.0).when(found, 0.92).when(by_span, 0.45).otherwise(0.0)
    return rows.select(doc, "l", F.coalesce("idx", "span_paragraph").alias("paragraph"), method.alias("method"), sure.alias("confidence"), "span_paragraph", F.coalesce("distance", F.when(by_span, 0.0)).alias("distance"))


BLOCKS = ArrayType(StructType([StructField(name, IntegerType()) for name in ("at", "there", "n")]))


@F.pandas_udf(BLOCKS)
def _anchors(want: pd.Series, heard: pd.Series) -> pd.Series:
    """The longest common runs of two word lists, in order, and their ends with no words."""
    words = lambda x: list(x) if x is not None else []
    return pd.Series([[tuple(b) for b in difflib.SequenceMatcher(None, words(a), words(b), autojunk=False).get_matching_blocks()] for a, b in zip(want, heard)])


def _between(at: Column, n: Column, there: Column, m: Column) -> Column:
    """Places for n words that stand where m others were heard: each at its share of the way; nulls where none were."""
    share = lambda k: F.bround(there + (k + 0.5) / n * m - 0.5).cast("int")
    inside = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.greatest(there, F.least(there + m - 1, share(k))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(m <= 0, F.array_repeat(F.lit(None).cast("int"), n)).otherwise(inside)


def heard_places(want: Column, heard: Column) -> Column:
    """(places, ratio): for each expected word its place among the heard ones, and twice the matched words' share of both lists.

    Between two matched runs a word has its share of the way; it is null where nothing was heard there.
    """
    end = lambda blocks, k, field: F.when(k == 0, F.lit(0)).otherwise(F.get(blocks, k - 1)[field] + F.get(blocks, k - 1)["n"])
    run = lambda b: F.when(b["n"] > 0, F.sequence(b["there"], b["there"] + b["n"] - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda blocks: lambda b, k: F.concat(
        _between(end(blocks, k, "at"), b["at"] - end(blocks, k, "at"), end(blocks, k, "there"), b["there"] - end(blocks, k, "there")), run(b)
    )
    matched = lambda blocks: F.aggregate(blocks, F.lit(0), lambda a, b: a + b["n"])
    total = F.greatest(F.size(want), F.lit(0)) + F.greatest(F.size(heard), F.lit(0))
    ratio = lambda blocks: F.when(total == 0, 1.0).otherwise(F.round(2.0 * matched(blocks) / total, 4))
    return let(_anchors(want, heard), lambda blocks: F.struct(F.flatten(F.transform(blocks, step(blocks))).alias("places"), ratio(blocks).alias("ratio")))
