"""Checking lines with a decision model: which lines to ask, questions, cached answers, verdicts.

The model is a function of pandas frames that the caller gives; every partition calls it on its own rows, and lines whose
call fails keep a null answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.scalars import ordered_distinct

# Limits of the gate and of the verdicts.
LEAST_CONFIDENCE, LEAST_MARGIN = 0.74, 0.14
IGNORE_BELOW, PROMOTE, DOWNGRADE = 0.4, 0.7, 0.6
NOT_DIALOGUE = "None"


# Rules that carry a speaker on, reasons that are a line's own evidence, names of nobody.
CARRYOVER = ("4b_tag_continuation", "4_contiguous_dialogue", "4c_carry_across_short_narration")
SUGGESTED = "5_suggest_alternatives"
LOCAL = (
    "post_quote_attribution", "post_quote_mention", "2_forward_explicit_tags", "2b_backward_explicit_tags", "coref_support", "alias_strength",
    "learned_descriptor_match", "context_gender_match",
)
NOBODY = ("", "unknown", "unassigned", "narrator")


def local_evidence(reasons: Column, local=LOCAL) -> Column:
    return F.coalesce(F.arrays_overlap(reasons, F.array(*map(F.lit, local))), F.lit(False))


def unknown_speaker(name: Column, nobody=NOBODY) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*nobody)


def gate_reasons(gate: str, is_dialogue: Column, rule: Column, reasons: Column, suggestion: Column, confidence: Column, margin: Column, decoded: Column) -> Column:
    """Why a dialogue line should be asked about, empty if nothing speaks for it. Gates: none; carryover: rules that carry on without evidence of the line's own; full: all."""
    carried = F.when(rule.isin(*CARRYOVER) & ~local_evidence(reasons), "carryover_rule")
    more = [
        F.when(suggestion, "already_suggestion"), F.when(confidence < LEAST_CONFIDENCE, "low_confidence"), F.when(margin < LEAST_MARGIN, "tight_margin"),
        F.when(decoded, "episode_decoder"), F.when(rule == SUGGESTED, "suggestion_string"),
    ]
    why = {"none": [], "carryover": [carried], "full": [carried, *more]}[gate]
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(is_dialogue, F.lit(False)), F.array_compact(F.array(*why)) if why else none).otherwise(none)


def roster(candidates: Column, last: Column, following: Column, names: Column, size: int = 6) -> Column:
    """Whom to ask about: the first three candidates, the last and the next speaker, as names (a map of lower-case names) has them; distinct, `size` at most."""
    all_ = F.filter(F.transform(F.concat(F.slice(candidates, 1, 3), F.array(last, following)), F.trim), lambda n: ~unknown_speaker(n))
    return F.slice(ordered_distinct(F.transform(all_, lambda n: F.coalesce(F.try_element_at(names, F.lower(n)), n)), fold_case=True), 1, size)


def applied(action: Column, choice: Column, confidence: Column, speaker: Column, suggestion: Column, suggestions: Column, candidates: Column, names: Column) -> Column:
    """A line after its verdict, as (speaker, suggestion, suggestions, candidates): nothing is lost, the model's pick comes first if it objects.

    candidates: array of (name, confidence, reasons); names: a map of lower-case names.
    """
    told = F.when((F.coalesce(choice, F.lit("")) != "") & (choice != NOT_DIALOGUE), F.coalesce(F.try_element_at(names, F.lower(F.trim(choice))), F.trim(choice)))
    told = F.when(~unknown_speaker(told), told)
    own, kept = F.trim(F.coalesce(speaker, F.lit(""))), F.coalesce(suggestions, F.array().cast("array<string>"))
    rows = F.coalesce(candidates, F.array().cast("array<struct<name:string,confidence:double,reasons:array<string>>>"))
    first = lambda name: ordered_distinct(F.filter(F.concat(F.array(name), kept), lambda n: F.trim(n) != ""), fold_case=True)
    objection = F.struct(told.alias("name"), F.round(confidence, 4).alias("confidence"), F.array(F.lit("jev_verification_disagreement")).alias("reasons"))
    others = F.filter(rows, lambda c: F.lower(F.trim(c["name"])) != F.lower(told))
    confirmed = F.transform(rows, lambda c, i: F.struct(c["name"].alias("name"), c["confidence"].alias("confidence"), F.when(i == 0, F.array_union(F.coalesce(c["reasons"], F.array().cast("array<string>")), F.array(F.lit("jev_verification_confirmed")))).otherwise(c["reasons"]).alias("reasons")))
    line = lambda who, unsure, offered, listed: F.struct(who.alias("speaker"), unsure.alias("suggestion"), offered.alias("suggestions"), listed.alias("candidates"))
    return (
        F.when((action == "downgrade") & told.isNotNull(), line(told, F.lit(True), first(told), F.concat(F.array(objection), others)))
        .when(action == "downgrade", line(own, F.lit(True), first(own), rows)).when((action == "confirm") & suggestion, line(speaker, F.lit(False), kept, confirmed))
        .otherwise(line(speaker, F.coalesce(suggestion, F.lit(False)), kept, rows))
    )


def question_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def answered(questions: DataFrame, cache: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """questions (key, ...) with choice and confidence: from the cache (key, choice, confidence), else from the model."""
    known = cache.select("key", "choice", "confidence").dropDuplicates(["key"])
    asked = questions.dropDuplicates(["key"]).join(known, "key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                got = model(frame)
            except Exception:  # the model is outside: a failed call leaves its lines unanswered
                got = frame.assign(choice=None, confidence=None)
            yield got[["key", "choice", "confidence"]]

    new = asked.mapInPandas(ask, "key string, choice string, confidence double")
    return questions.join(known.unionByName(new), "key", "left")


def verdict(choice: Column, confidence: Column, same: Column) -> Column:
    """skip, note, downgrade or confirm; a sure speaker is never changed in silence."""
    return (
        F.when(choice.isNull(), "skip").when(confidence < IGNORE_BELOW, "note").when(choice == NOT_DIALOGUE, "downgrade")
        .when(same, F.when(confidence >= PROMOTE, "confirm").otherwise("note")).when(confidence >= DOWNGRADE, "downgrade").otherwise("note")
    )
