"""Reports on predicted quotations and speakers against gold ones, and small summaries over lines and clips."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.scalars import ratio
from dialoom.operators import spans


def quote_report(gold: DataFrame, predicted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: detection and attribution figures of predicted (doc, r, start, end, speaker) against gold (doc, l, start, end, speaker).

    Quotations are matched one to one, in order, by the most matches and then the most overlap. All figures are of summed counts.
    """
    left = gold.select(doc, "l", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = predicted.select(doc, "r", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    matched = spans.aligned(spans.overlapping(left, right, doc), doc, least=0.0, ordered=True)
    matched = matched.join(gold.select(doc, "l", F.col("speaker").alias("g")), [doc, "l"]).join(predicted.select(doc, "r", F.col("speaker").alias("p")), [doc, "r"])
    labelled = F.col("g").isNotNull()
    sums = matched.agg(
        F.count("*").alias("matched"), F.count_if(labelled).alias("labelled"), F.count_if(labelled & F.col("p").isNotNull()).alias("resolved"),
        F.count_if(F.col("g") == F.col("p")).alias("correct"),
    )
    golds = gold.agg(F.count("*").alias("gold"), F.count_if(F.col("speaker").isNull()).alias("unresolved_gold"))
    row = sums.join(F.broadcast(golds)).join(F.broadcast(predicted.agg(F.count("*").alias("predicted"))))  # one row each
    m, g, p, c = (F.col(x) for x in ("matched", "gold", "predicted", "correct"))
    return row.withColumns({
        "precision": ratio(m, p), "recall": ratio(m, g), "f1": ratio(2 * m, g + p), "accuracy_on_matched": ratio(c, F.col("labelled")),
        "accuracy_on_resolved": ratio(c, F.col("resolved")), "end_to_end": ratio(c, g),
    })


def guess_hits(lines: DataFrame, gold: Column, suggestions: Column, ks=(1, 2, 3)) -> DataFrame:
    """One row: lines, and for each k those whose speaker is among the first k suggestions, names without regard to case."""
    want, offered = F.lower(F.trim(gold)), F.transform(F.coalesce(suggestions, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    hits = [F.count_if(F.coalesce(F.array_contains(F.slice(offered, 1, k), want), F.lit(False))).alias(f"hits_{k}") for k in ks]
    return lines.agg(F.count("*").alias("lines"), *hits)


def corpus_offsets(chapters: DataFrame, order: str, text: str, gap: int = 2, block: int = 1 << 16) -> DataFrame:
    """chapters with `offset`: where each begins, in code points, if they are joined in order with `gap` characters between them.

    order is a whole number that tells chapters apart. Sums run within blocks of so many numbers, and over the blocks' totals, so that
    no task takes the lengths of all.
    """
    size = F.coalesce(F.length(text), F.lit(0)) + gap
    blocked = chapters.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy("_block").agg(F.sum(size).alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one short row per block
    before = totals.select("_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(before, "_block").withColumn("offset", F.coalesce(F.sum(size).over(within), F.lit(0)) + F.col("_before")).drop("_block", "_before")


def followed_quotes(gold: DataFrame, quotes: DataFrame, doc: str, ahead: int = 8) -> DataFrame:
    """gold (doc, i, text) and quotes (doc, j, text, speaker), texts normalised -> doc, i, speaker.

    Each gold line takes the next quote of equal text among `ahead`, else the next quote, and goes on behind it; without
    quotes left its speaker is null. One fold per document, whose lines are one group.
    """
    kind = gold.schema[doc].dataType.simpleString()

    def walk(key, lines: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        offered, at, out = found.sort_values("j")[["text", "speaker"]].values.tolist(), 0, []
        for i, text in lines.sort_values("i")[["i", "text"]].itertuples(index=False):
            equal = next((j for j in range(at, min(at + ahead, len(offered))) if text and offered[j][0] == text), at)
            out.append((key[0], i, offered[equal][1] if equal < len(offered) else None))
            at = min(equal + 1, len(offered))
        return pd.DataFrame(out, columns=["d", "i", "speaker"])

    both = gold.groupBy(doc).cogroup(quotes.groupBy(doc)).applyInPandas(walk, f"d {kind}, i long, speaker string")
    return both.withColumnRenamed("d", doc)


def paragraph_of_span(lines: DataFrame, paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines (doc, l, start, end) with `paragraph`: the first that the span meets, else the nearest to its centre; null without any.

    paragraphs (doc, idx, start, end) do not overlap. Two looks back along the document, without pairs: the last paragraph that
    begins before the span ends, and, going on from there, the first that ends behind its start.
    """
    a = lines.select(doc, F.col("end").alias("_at"), F.lit(0).alias("_late"), F.struct(*lines.columns).alias("_row"), F.lit(None).cast("struct<start:bigint,end:bigint,idx:bigint>").alias("_p"))
    p = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("idx").cast("long").alias("idx"))
    b = paragraphs.select(doc, F.col("start").alias("_at"), F.lit(1).alias("_late"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), p.alias("_p"))
    both = a.unionByName(b)
    to_end = Window.partitionBy(doc).orderBy("_at", "_late")
    both = both.withColumns({"_before": F.last("_p", ignorenulls=True).over(to_end.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("_p", ignorenulls=True).over(to_end.rowsBetween(0, Window.unboundedFollowing))})
    rows = both.where("_row IS NOT NULL")
    # the first paragraph that ends behind the span's start
    starts = rows.select(doc, F.col("_row.start").alias("_at"), F.lit(0).alias("_late"), F.struct("_row", "_before", "_after").alias("_row"), F.lit(None).cast(p_type := both.schema["_p"].dataType).alias("_p"))
    ends = paragraphs.select(doc, F.col("end").alias("_at"), F.lit(1).alias("_late"), F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"), p.cast(p_type).alias("_p"))
    after_start = Window.partitionBy(doc).orderBy("_at", "_late").rowsBetween(0, Window.unboundedFollowing)
    # an end at the span's start is not behind it
    ends = ends.where("_p.end > _p.start").withColumn("_late", F.lit(-1))
    rows = starts.unionByName(ends).withColumn("_first", F.first("_p", ignorenulls=True).over(after_start)).where("_row IS NOT NULL")
    start, end, first = F.col("_row._row.start"), F.col("_row._row.end"), F.col("_first")
    meets = (first["start"] < end) & (first["end"] > start)
    centre = (start + end) / 2
    away = lambda q: F.when(centre < q["start"], q["start"] - centre).when(centre > q["end"], centre - q["end"]).otherwise(0.0)
    near = F.array_min(F.array_compact(F.array(*(F.when(q.isNotNull(), F.struct(away(q).alias("d"), q["idx"].alias("idx"))) for q in (F.col("_row._before"), F.col("_row._after"), first)))))["idx"]
    return rows.select("_row._row.*", F.when(meets, first["idx"]).otherwise(near).alias("paragraph"))


def voice_stats(clips: DataFrame, keys: list[str], voice: Column, total: Column) -> DataFrame:
    """Per key: clips, voices map voice -> clips, primary voice (most clips, then the first by name), coverage of `total`, null where that is 0."""
    rows = clips.withColumns({"_v": F.nullif(voice, F.lit("")), "_t": total})
    per = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.max("_t").alias("_t"))
    named = F.collect_list(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v"), F.col("_n"))))
    best = F.min(F.when(F.col("_v").isNotNull(), F.struct((-F.col("_n")).alias("less"), "_v")))
    out = per.groupBy(*keys).agg(F.sum("_n").alias("clips"), F.map_from_entries(F.array_sort(named)).alias("voices"), best["_v"].alias("primary"), F.max("_t").alias("total"))
    return out.withColumn("coverage", F.when(F.col("total") > 0, F.col("clips") / F.col("total")))


def outcome_counts(rows: DataFrame, outcome: Column, names: list[str]) -> DataFrame:
    """One row: all rows, and how many have each outcome."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(outcome == n, F.lit(False))).alias(n) for n in names))


def flagged_summary(reports: DataFrame, flagged: Column, line: str) -> DataFrame:
    """One row: reports, flagged ones, and the lines of these in order."""
    lines = F.array_sort(F.collect_list(F.when(flagged, F.col(line))))
    return reports.agg(F.count("*").alias("reports"), F.count_if(F.coalesce(flagged, F.lit(False))).alias("flagged"), lines.alias("lines"))


def nominal_mentions(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """entities (doc, coref, prop, cat, at, text) -> doc, coref, mentions: distinct nominal mentions of persons in order, in their first spelling."""
    text = F.trim("text")
    rows = entities.where((F.upper("prop") == "NOM") & (F.upper("cat") == "PER") & (F.coalesce(F.trim("coref"), F.lit("")) != "") & (text != ""))
    first = rows.groupBy(doc, F.trim("coref").alias("coref"), F.lower(text).alias("k")).agg(F.min(F.struct("at", text.alias("text"))).alias("m"))
    return first.groupBy(doc, "coref").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["text"]).alias("mentions"))


def cluster_names(entities: DataFrame, doc: str = "doc_id") -> DataFrame:
    """entities (doc, coref, prop, cat, at, text) -> doc, coref, name: the text of most weight among persons, then the first seen.

    Proper names weigh 10, nominal mentions 1, others 0.001; sums are of whole thousandths, so that ties are exact.
    """
    weight = F.when(F.col("prop") == "PROP", 10_000).when(F.col("prop") == "NOM", 1_000).otherwise(1)
    rows = entities.where((F.col("cat") == "PER") & (F.trim("text") != "")).withColumns({"text": F.trim("text"), "_w": weight})
    sums = rows.groupBy(doc, "coref", "text").agg(F.sum("_w").alias("_w"), F.min("at").alias("_at"))
    return sums.groupBy(doc, "coref").agg(F.max_by("text", F.struct("_w", -F.col("_at"))).alias("name"))


def dialogue_confidence(is_dialogue: Column, is_suggestion: Column, suggestions: Column, speaker: Column, text: Column, speech_verb: Column, group, order) -> Column:
    """How sure a line's speaker is, from 0 to 1: by suggestions, the neighbours' kinds, and what the narration before says. Narration: 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    at = lambda c, n: F.lag(c, n).over(w)
    is_dialogue = F.coalesce(is_dialogue, F.lit(False))
    n, less = F.coalesce(F.size(suggestions), F.lit(0)), lambda fits, x: F.when(F.coalesce(fits, F.lit(False)), x).otherwise(0.0)
    before, said = F.coalesce(at(text, 1), F.lit("")), at(is_dialogue, 1)
    base = F.when(F.coalesce(is_suggestion, F.lit(False)), 0.62).otherwise(0.98) - less(n > 1, 0.06) - less(n <= 0, 0.04) - less(said, 0.05) - less(at(is_dialogue, -1), 0.03)
    who, told = F.lower(F.trim(speaker)), F.coalesce(~said, F.lit(False))
    named = told & F.coalesce((who != "") & F.lower(before).contains(who), F.lit(False)) & F.coalesce(at(speech_verb, 1), F.lit(False))
    base = F.when(named & F.coalesce(at(is_dialogue, 2), F.lit(False)), F.least(base, F.lit(0.95))).when(named, F.greatest(base, F.lit(0.99))).otherwise(base)
    words = F.size(F.filter(F.split(before, r"\s+"), lambda x: x != ""))
    base = base - less(told & before.contains("\n\n"), 0.08) - less(told & (words >= 24), 0.08)
    return F.when(is_dialogue, F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))).otherwise(1.0)
