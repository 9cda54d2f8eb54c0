"""Clips of lines: the one to publish, those that claim another's line, and how well a transcript fits its line."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from dialoom.functions.text import tokens
from dialoom.operators.spans import similarity, token_similarity


def _slug(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(value), "[^a-zA-Z0-9_-]+", "-"), "-+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown"))


def _letters(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def clip_score(character: Column, output: Column, given: list[Column], folder: Column, source: Column, path: Column) -> Column:
    """How well a clip fits a line that wants `character` and `output`; given: the clip's id, name and folder, empty ones not counted."""
    character, output = (F.trim(F.coalesce(x, F.lit(""))) for x in (character, output))
    wanted = F.when(output.contains("/"), F.trim(F.substring_index(output, "/", 1))).otherwise("")
    name, clip = F.substring_index(output, "/", -1), F.substring_index(path, "/", -1)
    points = lambda test, n: F.when(test, n).otherwise(0)
    # The points of each agreement.
    score = points(source.endswith("/chapter.txt"), 10) + points(F.lower(clip).rlike(r"[^.].*\.wav$"), 5) + points((name != "") & (clip == name), 250)
    score += points((wanted != "") & (folder == wanted), 200) + points((output != "") & path.endswith(output), 300)
    for v in given:
        has = F.coalesce(v != "", F.lit(False))
        score += points(has & (v == character), 120) + points(has & (_slug(v) == _slug(character)), 70) + points(has & (_letters(v) == _letters(character)), 40)
        has = has & (wanted != "")
        score += points(has & (v == wanted), 110) + points(has & (_slug(v) == _slug(wanted)), 60) + points(has & (_letters(v) == _letters(wanted)), 30)
    return score


def resolved_clips(lines: DataFrame, candidates: DataFrame, line: str = "line") -> DataFrame:
    """lines (line, character, output) and candidates (line, id, name, folder, source, path, exists) -> line, path, score, candidates, status.

    The highest score wins, then .wav, then the path. `ambiguous`: another character's clip has that score too; `missing`: no
    candidate's file is there; `none`: no candidates.
    """
    wav = F.lower("path").rlike(r"[^./][^/]*\.wav$")
    score = clip_score(F.col("character"), F.col("output"), [F.col("id"), F.col("name"), F.col("folder")], F.col("folder"), F.coalesce("source", F.lit("")), F.col("path"))
    owner = F.array_sort(F.array_distinct(F.array(_letters(F.coalesce("id", F.lit(""))), _letters(F.coalesce("folder", F.lit(""))))))
    rows = lines.join(candidates, line).select(line, "path", F.coalesce("exists", F.lit(False)).alias("exists"), score.alias("score"), owner.alias("owner"), (~wav).alias("other"))
    there = F.when(F.col("exists"), F.struct("other", F.lower("path").alias("low"), "path"))
    by_score = rows.groupBy(line, "exists", "score").agg(F.count("*").alias("n"), F.min(there).alias("first"), (F.min("owner") != F.max("owner")).alias("several"))
    best = by_score.groupBy(line).agg(F.sum("n").alias("candidates"), F.max_by(F.struct("score", "first", "several"), F.when(F.col("exists"), F.col("score"))).alias("b"))
    status = F.when(F.col("candidates").isNull(), "none").when(F.col("b").isNull(), "missing").when(F.col("b.several"), "ambiguous").otherwise("ok")
    return lines.select(line).join(best, line, "left").select(line, F.col("b.first.path").alias("path"), F.col("b.score").alias("score"), F.coalesce("candidates", F.lit(0)).alias("candidates"), status.alias("status"))


def clip_conflicts(clips: DataFrame, group: str = "chapter", margin: float = 0.05) -> DataFrame:
    """clips with status, regenerate, suggested and in_chain.

    clips (group, clip, line, expected, similarity, best, best_score, said, wanted): the line of the file's name, the line
    expected and its similarity, the best line and its score, words said and wanted. Of several clips of a line the weaker ones
    are `duplicate_weaker_match`. A clip whose best line is the one before or after is suggested for that line; it is
    `adjacent_shift_lower_match` if the line's own clip is better by the margin, or another such clip is better. Lines n -> n-1
    and n+1 -> n together are a chain. Ties go to the lower clip.
    """
    bonus = F.when(F.col("wanted") > 0, F.least(F.lit(margin), margin * F.col("said") / F.col("wanted"))).otherwise(0.0)
    fit = lambda target: F.when(F.col("expected") == target, F.coalesce("similarity", F.lit(0.0)) + bonus).when(F.col("best") == target, F.coalesce("best_score", F.lit(0.0)) + bonus).otherwise(0.0)
    rank = lambda key, score: F.when(F.col(key).isNotNull(), F.row_number().over(Window.partitionBy(group, key).orderBy(F.desc(score), "clip")))
    rows = clips.withColumns({"_own": fit(F.col("line")), "_to": F.when(F.abs(F.col("best") - F.col("expected")) == 1, F.col("best"))})
    rows = rows.withColumn("_shift", fit(F.col("_to"))).withColumns({"_dup": rank("line", "_own"), "_rank": rank("_to", "_shift"), "_top": F.max("_shift").over(Window.partitionBy(group, "_to"))})
    owners = rows.where("line IS NOT NULL").groupBy(group, F.col("line").alias("_to")).agg(F.max("_own").alias("_owner"))
    moves = rows.where("_to IS NOT NULL").groupBy(group, "expected").agg(F.max_by("_to", "clip").alias("to"))
    links = moves.where("to = expected - 1")
    after = links.select(group, (F.col("expected") - 1).alias("expected"))
    pairs = links.join(after, [group, "expected"]).select(group, F.explode(F.array(F.col("expected"), F.col("expected") + 1)).alias("expected")).distinct()
    rows = rows.join(owners, [group, "_to"], "left").join(pairs.withColumn("_chain", F.lit(True)), [group, "expected"], "left")
    shifted = F.coalesce(F.col("_to").isNotNull() & ((F.coalesce("_owner", F.lit(0.0)) >= F.col("_top") + margin) | (F.col("_rank") > 1)), F.lit(False))
    doubled = F.coalesce(F.col("_dup") > 1, F.lit(False))
    status = F.when(shifted, "adjacent_shift_lower_match").when(doubled, "duplicate_weaker_match")
    return rows.select(*clips.columns, status.alias("status"), (shifted | doubled).alias("regenerate"), F.coalesce("_to", F.when(doubled, F.col("line"))).alias("suggested"), F.coalesce("_chain", F.lit(False)).alias("in_chain"))


COUNTS = ("expected", "said", "matched", "missing_start", "missing_end", "extra_leading", "extra_trailing")
FIT = StructType([StructField(c, IntegerType()) for c in COUNTS] + [StructField(c, DoubleType()) for c in ("matched_ratio", "focus_ratio")])


def _fit(want: list[str], said: list[str]) -> dict:
    blocks = [b for b in difflib.SequenceMatcher(None, want, said, autojunk=False).get_matching_blocks() if b.size]
    matched = sum(b.size for b in blocks)
    out = {"expected": len(want), "said": len(said), "matched": matched, "matched_ratio": round(matched / len(want), 4) if want else 1.0, "focus_ratio": round(matched / len(said), 4) if said else 0.0}
    if not blocks:
        return out | {"missing_start": len(want), "missing_end": len(want), "extra_leading": 0, "extra_trailing": 0}
    first, last = blocks[0], blocks[-1]
    return out | {"missing_start": first.a, "missing_end": len(want) - last.a - last.size, "extra_leading": first.b, "extra_trailing": len(said) - last.b - last.size}


@F.pandas_udf(FIT)
def token_fit(want: pd.Series, said: pd.Series) -> pd.DataFrame:
    """Words matched, and those missing or too many at either end; without a match, all are missing at both ends."""
    words = lambda x: list(x) if x is not None else []
    return pd.DataFrame([_fit(words(a), words(b)) for a, b in zip(want, said)], columns=FIT.names)


def fit_score(expected: Column, ratio: Column, missing: Column, before: Column, after: Column, leading: Column, tail: Column, trailing: Column, head: Column, empty: Column) -> Column:
    """Similarity, a bonus for matched words, less pressure from both neighbours, missing words, words of theirs, and silence."""
    # Weights and their bounds.
    less = lambda test, x: F.when(test, F.least(F.lit(0.08), x * 0.04)).otherwise(0.0)
    score = expected + F.least(F.lit(0.05), ratio * 0.05) - before - after - F.least(F.lit(0.12), missing * 0.015)
    return F.round(score - less(leading > 0, tail) - less(trailing > 0, head) - F.when(empty, 0.25).otherwise(0.0), 4)


def line_reports(lines: DataFrame, group: str, order: str, threshold: float, delta: float) -> DataFrame:
    """lines (group, order, text, transcript, both as they are compared) with similarity, before, after, fit, status and score.

    before and after say by how much more than `delta` the transcript fits the line together with the previous or next one. A
    line drifts if either is above 0, or words too many at an end are at 0.65 or more the neighbour's.
    """
    w = Window.partitionBy(group).orderBy(order)
    text, said = F.coalesce("text", F.lit("")), F.coalesce("transcript", F.lit(""))
    none = F.lit("")
    rows = lines.withColumns({"_t": text, "_s": said, "_p": F.coalesce(F.lag(text).over(w), none), "_n": F.coalesce(F.lead(text).over(w), none)})
    rows = rows.withColumns({"fit": token_fit(tokens(F.col("_t")), tokens(F.col("_s"))), "similarity": similarity("_t", "_s"), "_b": similarity(F.trim(F.concat_ws(" ", "_p", "_t")), F.col("_s")), "_a": similarity(F.trim(F.concat_ws(" ", "_t", "_n")), F.col("_s"))})
    pressure = lambda near, x: F.when(F.col(near) != "", F.round(F.greatest(F.lit(0.0), F.col(x) - F.col("similarity") - delta), 4)).otherwise(0.0)
    lead, trail = F.col("fit.extra_leading"), F.col("fit.extra_trailing")
    words, past, ahead = tokens(F.col("_s")), tokens(F.col("_p")), tokens(F.col("_n"))
    tail = token_similarity(F.slice(past, F.greatest(F.lit(1), F.size(past) - lead + 1), lead), F.slice(words, F.lit(1), lead))
    head = token_similarity(F.slice(ahead, F.lit(1), trail), F.slice(words, F.size(words) - trail + 1, trail))
    rows = rows.withColumns({"before": pressure("_p", "_b"), "after": pressure("_n", "_a"), "_tail": tail, "_head": head})
    rows = rows.withColumns({"tail": F.when((lead > 0) & (F.size(past) > 0), F.col("_tail")).otherwise(0.0), "head": F.when((trail > 0) & (F.size(ahead) > 0), F.col("_head")).otherwise(0.0)})
    drifts = F.expr("before > 0 OR after > 0 OR (fit.extra_leading > 0 AND tail >= 0.65) OR (fit.extra_trailing > 0 AND head >= 0.65)")
    empty = F.trim("_s") == ""
    status = F.when(empty, "empty-transcript").when(drifts, "likely-boundary-drift").when(F.col("similarity") < threshold, "needs-review").otherwise("ok")
    score = fit_score(F.col("similarity"), F.col("fit.matched_ratio"), F.col("fit.missing_start") + F.col("fit.missing_end"), F.col("before"), F.col("after"), lead, F.col("tail"), trail, F.col("head"), empty)
    return rows.withColumns({"status": status, "score": score}).drop("_t", "_s", "_p", "_n", "_b", "_a", "_tail", "_head")
