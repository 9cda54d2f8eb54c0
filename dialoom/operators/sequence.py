"""Neighbours, windows, runs and folds over ordered lines. group: columns that hold a chapter; order: its line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.cues import blocked_speaker
from dialoom.functions.scalars import greedy_starts, let, ordered_distinct, stretches


def _within(group, order):
    return Window.partitionBy(*group).orderBy(*order)


def last_known(value: Column, group, order, inclusive: bool = False) -> Column:
    """The last value that is not null before the row, or up to it."""
    return F.last(value, ignorenulls=True).over(_within(group, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))


def next_known(value: Column, group, order) -> Column:
    return F.first(value, ignorenulls=True).over(_within(group, order).rowsBetween(1, Window.unboundedFollowing))


def returning(is_dialogue: Column, paragraph, order) -> Column:
    """The last line of each paragraph that holds dialogue."""
    descending = Window.partitionBy(*paragraph).orderBy(*(F.desc(c) for c in order))
    return (F.row_number().over(descending) == 1) & F.max(is_dialogue).over(Window.partitionBy(*paragraph))


def turn_history(row: Column, position: Column, group, order, before: int = 4, after: int = 2) -> Column:
    """The rows around, without the row itself, in order: structs of position and row."""
    around = F.collect_list(F.struct(position.alias("at"), row.alias("row"))).over(_within(group, order).rowsBetween(-before, after))
    return F.filter(around, lambda x: x["at"] != position)


def roster(speaker: Column, group, order, reach: int = 5) -> Column:
    """Sorted distinct speakers of the rows around; null speakers left out."""
    return F.array_sort(F.collect_set(speaker).over(_within(group, order).rowsBetween(-reach, reach)))


def roster_by_value(speaker: Column, at: str, group, reach: int = 6, before: int = 4, after: int = 2) -> Column:
    """Distinct speakers where `at` differs by `reach` at most, then those of the rows around, in order of first sight."""
    near = F.collect_list(speaker).over(_within(group, [at]).rangeBetween(-reach, reach))
    return ordered_distinct(F.concat(near, F.collect_list(speaker).over(_within(group, [at]).rowsBetween(-before, after))))


def runs(lines: DataFrame, member: Column, group, order, target: Column) -> DataFrame:
    """Maximal runs of member rows that hold a target: group columns, run, size, targets, first, last (by the first of order)."""
    marked = lines.withColumns({"_member": F.coalesce(member, F.lit(False)), "_target": F.coalesce(target, F.lit(False))})
    marked = marked.withColumn("run", F.sum((~F.col("_member")).cast("int")).over(_within(group, order))).where("_member")
    found = marked.groupBy(*group, "run").agg(
        F.count("*").alias("size"), F.count_if("_target").alias("targets"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )
    return found.where("targets > 0")


def episode_ids(at: Column, group, order, gap) -> Column:
    """0, 1, ... : a new episode wherever `at` is more than `gap` above the row before; nulls do not split."""
    w = _within(group, order)
    return F.sum(F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(0))).over(w)


def running_count(value: Column, group, order) -> Column:
    return F.sum(value).over(_within(group, order).rowsBetween(Window.unboundedPreceding, 0))


def followed_by(first: Column, second: Column, group, order) -> Column:
    """Whether the row fits `first` and the next row fits `second`."""
    return F.coalesce(first & F.lead(second).over(_within(group, order)), F.lit(False))


def between_equals(speaker: Column, sure: Column, candidates: Column, group, order) -> Column:
    """The common speaker of the sure rows around an unsure one, if it is among the candidates; else the row's own."""
    known = F.when(sure, speaker)
    before, after = last_known(known, group, order), next_known(known, group, order)
    return F.when(~sure & (before == after) & F.array_contains(candidates, before), before).otherwise(speaker)


def recency_stack(speakers: Column, size: int = 5) -> Column:
    """The latest speakers of an ordered array, latest first: each is put on top unless it is there; those who are nobody are passed over."""
    empty = F.array().cast("array<string>")
    step = lambda stack, s: F.when(blocked_speaker(s) | F.coalesce(F.get(stack, F.lit(0)) == s, F.lit(False)), stack).otherwise(F.slice(F.concat(F.array(s), stack), 1, size))
    return F.aggregate(speakers, empty, step)


def two_speaker_path(scores: Column, stay: float = -0.28, change: float = 0.28) -> Column:
    """The best path of speakers 0 and 1 through an ordered array of (a, b) log scores; ties keep the lower speaker.

    A change of speaker is worth `change`, staying is worth `stay`: two speakers mostly alternate.
    """
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.array().cast("array<int>").alias("path_a"), F.array().cast("array<int>").alias("path_b"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.size(s["path_a"]) == 0
        aa, ba = s["a"] + F.when(fresh, 0.0).otherwise(stay), s["b"] + F.when(fresh, 0.0).otherwise(change)
        ab, bb = s["a"] + F.when(fresh, 0.0).otherwise(change), s["b"] + F.when(fresh, 0.0).otherwise(stay)
        return F.struct(
            (F.greatest(aa, ba) + x["a"]).alias("a"), (F.greatest(ab, bb) + x["b"]).alias("b"),
            F.concat(F.when(aa >= ba, s["path_a"]).otherwise(s["path_b"]), F.array(F.lit(0))).alias("path_a"),
            F.concat(F.when(ab >= bb, s["path_a"]).otherwise(s["path_b"]), F.array(F.lit(1))).alias("path_b"),
        )

    return F.aggregate(scores, start, step, lambda s: F.when(s["a"] >= s["b"], s["path_a"]).otherwise(s["path_b"]))


def packed_chunks(lengths: Column, least: int, most: int) -> Column:
    """Chunk numbers of an ordered array of lengths of lines joined by blanks: see greedy_starts(); a short last chunk joins the one before."""
    return let(greedy_starts(lengths, most, least), lambda starts: F.flatten(stretches(starts, F.size(lengths), lambda k, first, n: F.array_repeat(k, n))))


def merged_lines(lines: DataFrame, group, order: str, text: str) -> DataFrame:
    """Lines whose first letter is lower case, without a digit before it, join the line before them, if that is not blank, without a blank after a hyphen."""
    w = _within(group, [order])
    blank = F.coalesce(F.trim(F.lag(text).over(w)) == "", F.lit(True))
    starts = blank | ~F.coalesce(F.col(text).rlike(r"^[^\p{L}\p{Nd}]*\p{Ll}"), F.lit(False))
    found = lines.withColumn("_run", F.sum(starts.cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), "\n")
    found = found.groupBy(*group, "_run").agg(F.min(order).alias(order), F.count("*").alias("merged"), joined.alias(text))
    return found.drop("_run").withColumn(text, F.regexp_replace(F.regexp_replace(text, "-\n", "-"), "\n", " "))


def same_speaker_followup(row: Column, speaker: Column, is_narration: Column, group, order, window: int | None = None) -> Column:
    """`row` of the first line of the same speaker among `window` lines from the second next on, null if none.

    Without a window: of the next dialogue line from there on, null if another speaks it. Narration, unnamed lines and lines
    without a speaker have no follow-up.
    """
    spoken = F.when(~is_narration, F.struct(speaker.alias("who"), row.alias("row")))
    if window is None:
        # in reverse order the frame only grows, so the work is one step a line
        ahead = Window.partitionBy(*group).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -2)
        found = F.last(F.when(speaker.isNotNull(), spoken), ignorenulls=True).over(ahead)
    else:
        ahead = F.collect_list(spoken).over(_within(group, order).rowsBetween(2, window + 1))
        found = F.get(F.filter(ahead, lambda x: x["who"] == speaker), F.lit(0))
    return F.when((speaker != "") & ~is_narration & (found["who"] == speaker), found["row"])


#: Fixed value: the least confidence of a candidate.
LEAST_SCORE = 1e-6


def _named(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _scored(speaker: Column, candidates: Column) -> Column:
    """Candidates as (key, name, score), one per name without regard to case, the best and then the first; else the speaker at 0.5."""
    score = lambda c: F.greatest(F.lit(LEAST_SCORE), F.least(F.lit(1.0), F.coalesce(c["confidence"].cast("double"), F.lit(0.0))))
    made = lambda c: F.struct(_named(c["name"]).alias("key"), F.trim(c["name"]).alias("name"), score(c).alias("score"))
    rows = F.filter(F.transform(F.coalesce(candidates, F.array().cast("array<struct<name:string,confidence:double>>")), made), lambda c: c["key"] != "")
    best = lambda key: F.reduce(
        F.filter(rows, lambda c: c["key"] == key), F.get(F.filter(rows, lambda c: c["key"] == key), F.lit(0)), lambda a, c: F.when(c["score"] > a["score"], c).otherwise(a)
    )
    own = F.filter(F.array(F.struct(_named(speaker).alias("key"), F.trim(speaker).alias("name"), F.lit(0.5).alias("score"))), lambda c: c["key"] != "")
    return F.when(F.size(rows) > 0, F.transform(F.array_distinct(F.transform(rows, lambda c: c["key"])), best)).otherwise(own)


def decoded_episodes(lines: DataFrame, group, order: str, stay: float = -0.28, change: float = 0.28) -> DataFrame:
    """group, order, decoded, overridden for every row of lines (group, order, paragraph, speaker, candidates, hard, suggestion).

    Rows are dialogue lines. An episode ends where the paragraph rises by more than 1. Only episodes of two hard lines at
    least and two participants in all (speakers of hard lines, and all candidates) are decoded, and only suggestions that
    are not hard change, to one of their own candidates.
    """
    paragraph, keys = F.when(F.col("paragraph") >= 0, F.col("paragraph")), [*group, "_episode"]
    of = lines.select(
        *group, order, "speaker", F.coalesce("hard", F.lit(False)).alias("hard"), F.coalesce("suggestion", F.lit(False)).alias("suggestion"),
        episode_ids(paragraph, group, [order], 1).alias("_episode"), _scored(F.col("speaker"), F.col("candidates")).alias("all"),
    )
    key = _named(F.col("speaker"))
    fixed = (F.col("hard") | ~F.col("suggestion")) & (key != "")
    alone = F.array(F.struct(key.alias("key"), F.trim("speaker").alias("name"), F.lit(1.0).alias("score")))
    of = of.withColumns({"own": key, "open": F.when(fixed, alone).otherwise(F.col("all"))})
    line = F.struct(order, "speaker", "own", "hard", "suggestion", "all", "open")
    seen = F.flatten(F.transform("ls", lambda x: F.concat(F.transform(x["all"], lambda c: c["key"]), F.filter(F.array(F.when(x["hard"], x["own"])), lambda k: k != ""))))
    whole = of.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("ls"), F.count_if("hard").alias("anchors"))
    whole = whole.withColumn("two", F.array_sort(F.array_distinct(seen)))
    a, b = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    log = lambda x, k: F.coalesce(F.log(F.get(F.filter(x["open"], lambda c: c["key"] == k), F.lit(0))["score"]), F.lit(float("-inf")))
    steps = F.transform("ls", lambda x: F.struct(log(x, a).alias("a"), log(x, b).alias("b"), (F.get(x["open"], F.lit(0))["key"] == a).alias("a_first")))
    stuck = F.exists("steps", lambda x: (x["a"] == float("-inf")) & (x["b"] == float("-inf")))
    whole = whole.withColumn("steps", steps).withColumn("path", F.when((F.col("anchors") >= 2) & (F.size("two") == 2) & ~stuck, _episode_path(F.col("steps"), stay, change)))
    out = whole.select(*group, "two", F.explode(F.transform("ls", lambda x, i: F.struct(x.alias("l"), F.get("path", i).alias("at")))).alias("x"))
    x = F.col("x.l")
    chosen = F.get(F.filter(x["all"], lambda c: c["key"] == F.get("two", F.col("x.at"))), F.lit(0))
    over = F.coalesce(x["suggestion"] & ~x["hard"] & (chosen["key"] != x["own"]), F.lit(False))
    return out.select(*group, x[order].alias(order), F.when(over, chosen["name"]).otherwise(x["speaker"]).alias("decoded"), over.alias("overridden"))


def _episode_path(steps: Column, stay: float, change: float) -> Column:
    """two_speaker_path() for steps (a, b, a_first) with absent speakers at -inf; ties go to the line's first candidate."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), none.alias("path_a"), none.alias("path_b"), F.lit(True).alias("a_first"))

    def first(s: Column, a: Column, b: Column) -> Column:
        return (a > b) | ((a == b) & s["a_first"])

    def step(s: Column, x: Column) -> Column:
        fresh = F.size(s["path_a"]) == 0
        held, moved = F.when(fresh, 0.0).otherwise(stay), F.when(fresh, 0.0).otherwise(change)
        aa, ba, ab, bb = s["a"] + x["a"] + held, s["b"] + x["a"] + moved, s["a"] + x["b"] + moved, s["b"] + x["b"] + held
        return F.struct(
            F.greatest(aa, ba).alias("a"), F.greatest(ab, bb).alias("b"),
            F.concat(F.when(first(s, aa, ba), s["path_a"]).otherwise(s["path_b"]), F.array(F.lit(0))).alias("path_a"),
            F.concat(F.when(first(s, ab, bb), s["path_a"]).otherwise(s["path_b"]), F.array(F.lit(1))).alias("path_b"), x["a_first"].alias("a_first"),
        )

    return F.aggregate(steps, start, step, lambda s: F.when(first(s, s["a"], s["b"]), s["path_a"]).otherwise(s["path_b"]))
