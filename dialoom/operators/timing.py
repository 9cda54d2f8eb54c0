"""Times of lines from recognised words, and boundaries near an anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_times(lines: DataFrame, matches: DataFrame, words: DataFrame, group: str, duration: str) -> DataFrame:
    """lines (group, line, duration) with start, end, seconds, matched, first_word and last_word.

    matches: (group, line, word), the words that a line's tokens were mapped to; words: (group, word from 0, start, end),
    times may be null. A line without matches takes the last word of the one before (at first, word 0). A word without
    a time takes the nearest one that has. Times never run back, nor past the duration, to which the last line extends.
    Lines that no time is known for begin where the one before ends. One window per group; groups are chapters.
    """
    spans = matches.groupBy(group, "line").agg(F.min("word").alias("first_word"), F.max("word").alias("last_word"), F.count("*").alias("matched"))
    rows = lines.select(group, "line", duration).join(spans, [group, "line"], "left")
    w = Window.partitionBy(group).orderBy("line")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last("last_word", ignorenulls=True).over(earlier), F.lit(0))
    rows = rows.withColumns({"_carried": carried, "matched": F.coalesce("matched", F.lit(0))}).withColumns({
        "first_word": F.coalesce("first_word", "_carried"), "last_word": F.coalesce("last_word", "_carried"),
    }).drop("_carried")

    v = Window.partitionBy(group).orderBy("word")
    before, after = v.rowsBetween(Window.unboundedPreceding, 0), v.rowsBetween(0, Window.unboundedFollowing)
    ended, begins = F.last("end", ignorenulls=True).over(before), F.first("start", ignorenulls=True).over(after)
    near = words.select(group, "word", F.coalesce(begins, ended).alias("_from"), F.coalesce(ended, begins).alias("_to"))
    rows = rows.join(near.select(group, F.col("word").alias("first_word"), "_from"), [group, "first_word"], "left")
    rows = rows.join(near.select(group, F.col("word").alias("last_word"), "_to"), [group, "last_word"], "left")

    limit = F.col(duration)
    capped = lambda c: F.when(F.col(c).isNotNull(), F.least(F.col(c), limit))
    rows = rows.withColumns({"_from": capped("_from"), "_to": capped("_to")})
    rows = rows.withColumn("_last", F.coalesce(F.max(F.greatest("_from", "_to")).over(earlier), F.lit(0.0))).withColumn("_last", F.greatest("_last", F.lit(0.0)))
    rows = rows.withColumn("_start", F.greatest("_last", "_from")).withColumn("_end", F.greatest("_start", "_to"))
    start, end = F.round("_start", 4), F.round("_end", 4)
    final = F.lead("line").over(w).isNull() & (end < limit)
    rows = rows.withColumns({"start": start, "end": F.when(final, F.round(limit, 4)).otherwise(end)})
    return rows.select(group, "line", "start", "end", F.round(F.col("end") - F.col("start"), 4).alias("seconds"), "matched", "first_word", "last_word")


def nearest_boundary(runs: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, boundary: of silent runs (keys, place, center, seconds) the centre nearest to the anchor (keys, anchor), of
    equal ones the longer, then the first; the anchor itself where there is no run."""
    rank = F.struct(F.abs(F.col("center") - F.col("anchor")), -F.col("seconds"), F.col("place"))
    met = anchors.join(runs.where("center IS NOT NULL"), keys, "left")
    best = met.groupBy(*keys, "anchor").agg(F.min_by("center", F.when(F.col("center").isNotNull(), rank)).alias("_c"))
    return best.select(*keys, F.round(F.coalesce("_c", "anchor"), 4).alias("boundary"))


def boundary_candidates(runs: DataFrame, anchors: DataFrame, keys: list[str], side: int) -> DataFrame:
    """keys, position: the anchor and the nearest `side` (1 or more) distinct centres before and after it, to 4 digits."""
    centres = runs.where("center IS NOT NULL").select(*keys, F.round("center", 4).alias("position")).distinct()
    places = anchors.select(*keys, F.round("anchor", 4).alias("position")).unionAll(centres).distinct().join(anchors, keys)
    far = F.abs(F.col("position") - F.col("anchor"))
    w = Window.partitionBy(*keys, F.signum(F.col("position") - F.col("anchor"))).orderBy(far)
    kept = places.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= side) | (F.col("position") == F.round("anchor", 4)))
    return kept.select(*keys, "position")
