"""Candidates: scoring, collapsing, ranking with margins, exact samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.cues import generic_label, normal
from dialoom.functions.scalars import clamped, let

# The base score of a candidate, the deltas of reasons, and the limits of a suggestion.
BASE, LOW, HIGH = 0.38, 0.02, 0.98
DELTAS = {
    "parser_match_exact": 0.20, "parser_match": 0.08, "legacy_match": 0.16, "legacy_anchor_boost": 0.10, "same_paragraph_continuation": 0.40,
    "prev_continuity": 0.10, "next_continuity": 0.10, "two_sided_continuity": 0.08, "paragraph_sibling_confirmed": 0.30, "coref_support": 0.08,
    "learned_descriptor_match": 0.40, "post_quote_attribution": 0.40, "post_quote_mention": 0.40, "recent_named_mention": 0.16,
    "previous_paragraph_named_mention": 0.16, "speech_verb": 0.06, "fallback_penalty": -0.10, "generic_label_penalty": -0.20,
    "addressed_target_penalty": -0.18, "self_name_mention_penalty": -0.15, "context_gender_match": 0.18, "context_gender_conflict": -0.34,
    "question_next_speaker_penalty": -0.18,
}
LEAST_TOP, LEAST_MARGIN, LEAST_TOP_SOFT = 0.74, 0.14, 0.80
ALIAS_SHARE, BOUNDARY_SHARE, NARRATOR = 0.08, 0.08, "narrator"
HARD = (
    "parser_match", "coref_support", "legacy_match", "post_quote_attribution", "recent_named_mention", "previous_paragraph_named_mention", "same_paragraph_continuation",
    "paragraph_sibling_confirmed", "speech_verb", "alias_strength", "learned_descriptor_match", "context_gender_match",
)


def score_of(reasons: Column, extra: Column | float = 0.0) -> Column:
    """The base score plus the deltas of an array of reasons, within [LOW, HIGH]."""
    total = F.lit(BASE) + extra
    for name, delta in DELTAS.items():
        total = total + F.when(F.array_contains(reasons, name), delta).otherwise(0.0)
    return clamped(total, LOW, HIGH)


#: What is known of a line, as fields of a struct; all may be null.
SIGNALS = (
    "predicted string, legacy string, previous string, following string, fallback boolean, exact boolean, boundary double, speech_verb boolean, coref boolean, alias_strength double, addressed string, "
    "mentions array<string>, attributed string, recent string, previous_paragraph string, genders map<string,string>, gender string, returning boolean, continues boolean, question boolean, "
    "next_legacy string, descriptor string, post_quote string, sibling string"
)


def _evidence(key: Column, s: Column, several: Column, named: Column) -> list[tuple[Column, str | None, Column | float]]:
    """(condition, reason, delta) of everything that speaks for or against a candidate, in the order in which it is added up."""
    yes = lambda name: F.coalesce(s[name], F.lit(False))
    known = lambda name: normal(s[name]) != ""
    is_ = lambda name: key == normal(s[name])
    someone = key != NARRATOR
    number = lambda name: F.coalesce(s[name], F.lit(0.0))
    # a name that the text after the quotation gives takes from all others what only continuity gave them
    anchor = F.coalesce(F.nullif(normal(s["attributed"]), F.lit("")), F.nullif(normal(s["post_quote"]), F.lit("")))
    free = anchor.isNull() | (key == anchor)
    legacy = is_("legacy") & someone & free
    before, after = known("previous") & is_("previous"), known("following") & is_("following")
    gender = F.nullif(F.try_element_at(s["genders"], key), F.lit(""))
    sexed = known("gender") & gender.isNotNull() & someone
    d = DELTAS
    return [
        (is_("predicted") & free, "parser_match", F.when(yes("exact"), d["parser_match_exact"]).otherwise(d["parser_match"])),
        (legacy, "legacy_match", d["legacy_match"]),
        (legacy & (yes("fallback") | generic_label(s["predicted"])), "legacy_anchor_boost", d["legacy_anchor_boost"]),
        (before & yes("continues"), "same_paragraph_continuation", d["same_paragraph_continuation"]),
        (before & ~yes("continues"), "prev_continuity", d["prev_continuity"]),
        (after, "next_continuity", d["next_continuity"]),
        (known("sibling") & is_("sibling"), "paragraph_sibling_confirmed", d["paragraph_sibling_confirmed"]),
        (before & after, None, d["two_sided_continuity"]), (before & after, "two_sided_continuity", 0.0),
        (is_("predicted") & yes("coref"), "coref_support", d["coref_support"]),
        (is_("predicted"), None, number("alias_strength") * ALIAS_SHARE), (is_("predicted") & (number("alias_strength") > 0), "alias_strength", 0.0),
        (is_("descriptor") & someone, "learned_descriptor_match", d["learned_descriptor_match"]),
        (known("attributed") & is_("attributed") & someone, "post_quote_attribution", d["post_quote_attribution"]),
        (known("post_quote") & is_("post_quote") & someone, "post_quote_mention", d["post_quote_mention"]),
        (known("recent") & is_("recent") & someone, "recent_named_mention", d["recent_named_mention"]),
        (known("previous_paragraph") & is_("previous_paragraph") & someone, "previous_paragraph_named_mention", d["previous_paragraph_named_mention"]),
        (F.lit(True), None, number("boundary") * BOUNDARY_SHARE),
        (yes("speech_verb"), "speech_verb", d["speech_verb"]),
        (yes("fallback") & is_("predicted"), "fallback_penalty", d["fallback_penalty"]),
        (named & generic_label(key), "generic_label_penalty", d["generic_label_penalty"]),
        (known("addressed") & is_("addressed") & someone & several, "addressed_target_penalty", d["addressed_target_penalty"]),
        (F.exists(F.coalesce(s["mentions"], F.array().cast("array<string>")), lambda m: normal(m) == key) & someone & several, "self_name_mention_penalty", d["self_name_mention_penalty"]),
        (sexed & (normal(gender) == normal(s["gender"])), "context_gender_match", d["context_gender_match"]),
        (sexed & (normal(gender) != normal(s["gender"])), "context_gender_conflict", d["context_gender_conflict"]),
        (yes("returning") & yes("question") & known("next_legacy") & is_("next_legacy") & someone & several, "question_next_speaker_penalty", d["question_next_speaker_penalty"]),
    ]


def decision(candidates: Column, signals: Column) -> Column:
    """(ranked array<(score, name, reasons)>, chosen, top, margin, hard, suggestion) of an array of names and a struct of SIGNALS.

    Names that differ in case or outer blanks only are one candidate, the first; without any, the predicted or legacy name or
    Narrator is. Keys of genders are lower case. Candidates are ranked by score, then by their order. The choice is only a suggestion if it stands on a
    fallback alignment, scores or leads too little, is the one whom the line asks, has the other gender, is generic where a
    name is not, or has no hard reason and no high score.
    """
    named = F.filter(F.transform(F.coalesce(candidates, F.array().cast("array<string>")), lambda n: F.trim(F.coalesce(n, F.lit("")))), lambda n: n != "")

    def first_of(names: Column) -> Column:
        keys = F.transform(names, F.lower)
        return F.filter(names, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)

    fallback = F.coalesce(F.nullif(signals["predicted"], F.lit("")), F.nullif(signals["legacy"], F.lit("")), F.lit("Narrator"))
    unique = F.when(F.size(named) > 0, first_of(named)).otherwise(F.array(fallback))

    def of(names: Column) -> Column:
        several = F.size(F.filter(names, lambda n: normal(n) != NARRATOR)) >= 2
        specific = F.exists(names, lambda n: (normal(n) != NARRATOR) & ~generic_label(n))

        def one(n: Column, i: Column) -> Column:
            score, reasons = F.lit(BASE), []
            for fits, reason, delta in _evidence(normal(n), signals, several, specific):
                score = score + F.when(fits, delta).otherwise(0.0)
                if reason:
                    reasons.append(F.when(fits, F.lit(reason)))
            score = clamped(score, LOW, HIGH)
            return F.struct((-score).alias("_down"), i.alias("_i"), score.alias("score"), n.alias("name"), F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))

        def decided(x: Column) -> Column:
            top, next_ = x[0], F.coalesce(F.get(x, F.lit(1))["score"], F.lit(0.0))
            margin, hard = top["score"] - next_, F.size(F.array_intersect(top["reasons"], F.array(*map(F.lit, HARD))))
            has = lambda reason: F.array_contains(top["reasons"], reason)
            doubt = (
                F.coalesce(signals["fallback"], F.lit(False)) | (top["score"] < LEAST_TOP) | (margin < LEAST_MARGIN) | has("question_next_speaker_penalty") | has("context_gender_conflict")
                | (generic_label(top["name"]) & specific) | ((hard == 0) & (top["score"] < LEAST_TOP_SOFT))
            )
            ranked_ = F.transform(x, lambda c: F.struct(c["score"].alias("score"), c["name"].alias("name"), c["reasons"].alias("reasons")))
            return F.struct(ranked_.alias("ranked"), top["name"].alias("chosen"), top["score"].alias("top"), margin.alias("margin"), hard.alias("hard"), doubt.alias("suggestion"))

        return let(F.array_sort(F.transform(names, one)), decided)

    return let(unique, of)


def ranked(candidates: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """rank (by score, then order), margin of the first over the second, and whether it is only a suggestion."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    out = candidates.withColumns({"rank": F.row_number().over(w), "_next": F.lead(score).over(w)})
    out = out.withColumn("margin", F.when(F.col("rank") == 1, F.greatest(F.lit(0.0), F.col(score) - F.coalesce("_next", F.lit(0.0))))).drop("_next")
    return out.withColumn("suggestion", F.when(F.col("rank") == 1, (F.col(score) < LEAST_TOP) | (F.col("margin") < LEAST_MARGIN)))


def collapsed(candidates: DataFrame, keys: list[str], identity: str, confidence: str, reason: str, order: str) -> DataFrame:
    """One row per mapped identity: highest confidence, sorted distinct reasons, first place."""
    return candidates.groupBy(*keys, identity).agg(
        F.max(confidence).alias("confidence"), F.array_sort(F.collect_set(reason)).alias("reasons"), F.min(order).alias("first_place")
    )


def exact_sample(rows: DataFrame, key: Column, k: int, seed: int = 42) -> DataFrame:
    """Exactly k rows (all, if fewer), the same ones each time: those of the lowest hash of seed and key."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))).orderBy("_h").limit(k).drop("_h")


def disposition(top: Column, margin: Column, threshold: float, uncertain: Column) -> Column:
    """auto_apply at or above the threshold, with uncertain ones held at 0.72; else review."""
    return F.when(F.when(uncertain, F.least(top, F.lit(0.72))).otherwise(top) >= threshold, "auto_apply").otherwise("review")


def risk(top: Column, margin: Column) -> Column:
    return (1 - top) * 0.7 + (1 - margin) * 0.3
