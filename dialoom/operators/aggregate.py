"""Statistics, votes and agreement reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.scalars import ratio


def counts_matrix(lines: DataFrame, character: Column, chapter: Column) -> DataFrame:
    """(character, chapter, n): lines per trimmed, non-empty character and chapter."""
    rows = lines.select(F.trim(character).alias("character"), chapter.alias("chapter")).where("character <> ''")
    return rows.groupBy("character", "chapter").agg(F.count("*").alias("n"))


def character_stats(matrix: DataFrame) -> DataFrame:
    """(character, total_lines, chapter_count) of a counts matrix, which has a chapter once per character."""
    return matrix.groupBy("character").agg(F.sum("n").alias("total_lines"), F.count("*").alias("chapter_count"))


def breakdown(matrix: DataFrame) -> DataFrame:
    """(chapter, total, breakdown map character -> n); a chapter's map has as many entries as it has characters."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("character", "n"))))
    return matrix.groupBy("chapter").agg(F.sum("n").alias("total"), entries.alias("breakdown"))


def strict_vote(votes: DataFrame, keys: list[str], choice: str, weight: Column) -> DataFrame:
    """keys, winner, top, second: the choice of most weight, null unless strictly ahead."""
    sums = votes.groupBy(*keys, choice).agg(F.sum(weight).alias("_w"))
    both = sums.groupBy(*keys).agg(F.max("_w").alias("top"), F.max_by(choice, F.struct("_w", choice)).alias("_c"), F.slice(F.sort_array(F.collect_list("_w"), asc=False), 1, 2).alias("_two"))
    second = F.when(F.size("_two") > 1, F.col("_two")[1])
    return both.select(*keys, F.when(second.isNull() | (F.col("top") > second), F.col("_c")).alias("winner"), "top", second.alias("second"))


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """keys, mode, n: the most frequent value; of several, the one seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("less"), "_first", value)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{value}").alias("mode"), (-F.col("_b.less")).alias("n"))


def class_report(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall, f1. pairs: one row per line; null predictions are misses."""
    rows = pairs.select(F.col(gold).cast("string").alias("g"), F.col(predicted).cast("string").alias("p"))
    hit = F.col("g").eqNullSafe(F.col("p")).cast("int")
    said = rows.where("p IS NOT NULL").select(F.col("p").alias("class"), hit.alias("tp"), (1 - hit).alias("fp"), F.lit(0).alias("fn"))
    meant = rows.where("g IS NOT NULL AND NOT g <=> p").select(F.col("g").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    sums = said.unionAll(meant).groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return sums.select("class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def micro_report(lines: DataFrame, chapter: str, correct: Column, asserted: Column) -> DataFrame:
    """Per chapter and for all (null chapter): total, correct, asserted, assert_correct, and ratios of the summed counts."""
    good, sure = F.coalesce(correct, F.lit(False)), F.coalesce(asserted, F.lit(False))
    sums = lines.withColumns({"_g": good, "_s": sure}).rollup(chapter).agg(
        F.grouping(chapter).cast("int").alias("is_total"), F.count("*").alias("total"), F.count_if("_g").alias("correct"),
        F.count_if("_s").alias("asserted"), F.count_if(F.col("_g") & F.col("_s")).alias("assert_correct"),
    )
    return sums.withColumns({"accuracy": ratio(F.col("correct"), F.col("total")), "assert_precision": ratio(F.col("assert_correct"), F.col("asserted"))})


def report_delta(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left, right, delta over the keys of both; a side that lacks a key is null there."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return a.join(b, key, "full_outer").withColumn("delta", F.col("right") - F.col("left"))


def cue_report(lines: DataFrame, gold: Column, current: Column, cues: dict[str, Column]) -> DataFrame:
    """Per cue: support, cue_correct, changed, fixes, regressions, wrong_to_wrong, if its proposal replaced the current answer."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("cue"), v.cast("string").alias("proposed")) for k, v in cues.items())))
    rows = lines.select(gold.cast("string").alias("g"), current.cast("string").alias("c"), each.alias("x")).select("g", "c", "x.*").where("proposed IS NOT NULL")
    was, now, moved = F.col("g").eqNullSafe(F.col("c")), F.col("g").eqNullSafe(F.col("proposed")), ~F.col("c").eqNullSafe(F.col("proposed"))
    return rows.groupBy("cue").agg(
        F.count("*").alias("support"), F.count_if(now).alias("cue_correct"), F.count_if(moved).alias("changed"), F.count_if(moved & now).alias("fixes"),
        F.count_if(moved & was).alias("regressions"), F.count_if(moved & ~was & ~now).alias("wrong_to_wrong"),
    )


def learned_gender(previous: Column, male: Column, female: Column, lead: int = 2) -> Column:
    """The sex of more evidence, if it leads by `lead`; otherwise what was known."""
    return F.when(male - female >= lead, "male").when(female - male >= lead, "female").otherwise(previous)
