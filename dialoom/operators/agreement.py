"""Predicted speakers against curated ones, line by line, and names of speakers as they pass between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators.spans import interval_of

NARRATOR = "narrator"


def positional_pairs(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gold, predicted (null where no line stands in that place): both tables are (keys, who), null who narrates."""
    who = F.coalesce("who", F.lit(NARRATOR))
    return gold.select(*keys, who.alias("gold")).join(predicted.select(*keys, who.alias("predicted")), keys, "left")


def positional_report(pairs: DataFrame, chapter: str) -> DataFrame:
    """Per chapter: total, correct, and the same of dialogue, which is what the narrator does not say."""
    right, said = F.col("gold").eqNullSafe(F.col("predicted")), F.col("gold") != NARRATOR
    return pairs.groupBy(chapter).agg(
        F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count_if(said).alias("dialogue_total"), F.count_if(said & right).alias("dialogue_correct"),
    )


def positional_characters(pairs: DataFrame) -> DataFrame:
    """Per character: tp, fp, fn over lines of dialogue. A missing line is only an fn; the narrator is never an fp."""
    sums = pairs.where(F.col("gold") != NARRATOR).groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    hit, none = F.col("gold").eqNullSafe(F.col("predicted")), F.lit(0).cast("long")
    meant = sums.select(F.col("gold").alias("character"), F.when(hit, F.col("n")).otherwise(none).alias("tp"), none.alias("fp"), F.when(hit, none).otherwise(F.col("n")).alias("fn"))
    wrong = sums.where(~hit & F.col("predicted").isNotNull() & (F.col("predicted") != NARRATOR))
    both = meant.unionAll(wrong.select(F.col("predicted").alias("character"), none.alias("tp"), F.col("n").alias("fp"), none.alias("fn")))
    return both.groupBy("character").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def method_report(lines: DataFrame, chapter: str, gold: Column, methods: dict[str, Column]) -> DataFrame:
    """Per chapter and method: total, correct, dialogue_total, dialogue_correct; an answer that is null narrates."""
    who = F.coalesce(gold, F.lit(NARRATOR))
    said = who != NARRATOR
    right = {name: who == F.coalesce(answer, F.lit(NARRATOR)) for name, answer in methods.items()}
    counts = [F.count_if(c).alias(f"{p}{i}") for i, r in enumerate(right.values()) for p, c in (("c", r), ("d", r & said))]
    sums = lines.groupBy(chapter).agg(F.count("*").alias("total"), F.count_if(said).alias("dialogue_total"), *counts)
    each = F.array(*(F.struct(F.lit(name).alias("method"), F.col(f"c{i}").alias("correct"), F.col(f"d{i}").alias("dialogue_correct")) for i, name in enumerate(methods)))
    return sums.select(chapter, "total", "dialogue_total", F.explode(each).alias("x")).select(chapter, "total", "dialogue_total", "x.*")


def verdict_counts(rows: DataFrame, verdict: Column, names: list[str]) -> DataFrame:
    """(verdict, n, share) for each of `names`, also those that do not occur; shares are of all of them together."""
    sums = rows.agg(*(F.count_if(verdict == name).alias(f"n{i}") for i, name in enumerate(names)))
    each = F.array(*(F.struct(F.lit(name).alias("verdict"), F.col(f"n{i}").alias("n")) for i, name in enumerate(names)))
    total = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    found = sums.select(total.alias("total"), F.explode(each).alias("x"))
    return found.select("x.verdict", "x.n", F.coalesce(F.col("x.n") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("share"))


def rebased(quotes: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """quotes (book, start, end, ...) of whole books as (book, idx, ...) with offsets of their chapter.

    chapters: (book, idx, start, end, text, sha256), disjoint. A quote that reaches over its chapter's end goes, and so do
    all of a chapter whose text is no longer the one that sha256 was taken of.
    """
    places = chapters.where(F.sha2("text", 256) == F.col("sha256")).select(book, F.col("idx").cast("int").alias("idx"), F.col("start").alias("_at"), F.col("end").alias("_to"))
    found = interval_of(quotes.withColumn("at", F.col("start")), chapters.select(book, "idx", "start", "end"), book).drop("at")
    inside = found.join(places, [book, "idx"]).where(F.col("end") <= F.col("_to"))
    return inside.withColumns({"start": F.col("start") - F.col("_at"), "end": F.col("end") - F.col("_at")}).drop("_at", "_to")


def cleaned_suggestions(speaker: Column, blocked: tuple[str, ...]) -> Column:
    """A "[a|b]" of suggestions without empty, blocked or repeated names; one name stands alone, none is null. Others are trimmed."""
    value = F.trim(F.coalesce(speaker, F.lit("")))
    low = lambda x: F.lower(F.trim(x))
    parts = F.filter(F.transform(F.split(F.btrim(value, F.lit("[]")), r"\|"), lambda x: F.trim(x)), lambda x: (x != "") & ~low(x).isin(*blocked))
    keys = F.transform(parts, low)
    kept = F.filter(parts, lambda x, i: F.array_position(keys, low(x)) == i + 1)
    listed = F.when(F.size(kept) == 0, None).when(F.size(kept) == 1, F.get(kept, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(kept, "|"), F.lit("]")))
    return F.when(value == "", None).when(~(value.startswith("[") & value.endswith("]")), value).otherwise(listed)


def coref_names(mentions: DataFrame, doc: str, blocked: tuple[str, ...]) -> DataFrame:
    """(doc, start, name) from mentions (doc, cluster, place, start, text, name, known): name is the resolved text.

    A cluster's name is that of its first known mention, else of its longest that is neither blocked nor "I" or "we", the
    first of equal ones. Clusters without a name, or with a blocked one, give nothing; where several start, the last counts.
    """
    low = lambda c: F.lower(F.trim(c))
    first = F.min_by("name", F.when(F.coalesce("known", F.lit(False)), F.col("place")))
    usable = ~low("text").isin(*blocked) & ~F.lower("text").isin("i", "we")
    longest = F.max_by("name", F.when(usable, F.struct(F.length("text"), -F.col("place"))))
    named = mentions.groupBy(doc, "cluster").agg(F.coalesce(first, longest).alias("_name")).where((F.col("_name") != "") & ~low("_name").isin(*blocked))
    return mentions.join(named, [doc, "cluster"]).groupBy(doc, "start").agg(F.max_by("_name", "cluster").alias("name"))


def usable_gender_cue(speaker: Column, conflict: Column, gender_conflict: Column, gender: Column) -> Column:
    """Whether a line tells of its speaker's sex: a named speaker, no conflict, and a cue of male or female."""
    named = ~F.lower(F.trim(F.coalesce(speaker, F.lit("")))).isin("", "unknown", NARRATOR)
    clear = ~F.coalesce(conflict, F.lit(False)) & ~F.coalesce(gender_conflict, F.lit(False))
    return named & clear & F.lower(F.trim(F.coalesce(gender, F.lit("")))).isin("male", "m", "female", "f")


def reviewable(character: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(character, F.lit("")))).isin("", NARRATOR)


def chapter_characters(lines: DataFrame, records: DataFrame, lookup: DataFrame, order: str) -> DataFrame:
    """(chapter, character, id, name, place) of lines (chapter, character): every character but the narrator, once.

    records: (id, name); lookup: (surface, id), by lower-case surface with _ and - as blanks. The record of that id, else
    of that surface; a character that has neither is named after its id, words capitalised. place: its first line.
    """
    said = lines.withColumn("character", F.trim("character")).where(f"character <> '' AND character <> '{NARRATOR}'")
    each = said.groupBy("chapter", "character").agg(F.min(order).alias("place"))
    plain = F.translate("character", "_-", "  ")
    byid = records.select(F.col("id").alias("character"), F.col("id").alias("_a"), F.col("name").alias("_an"))
    bysurface = lookup.join(records, "id").select(F.col("surface").alias("_s"), F.col("id").alias("_b"), F.col("name").alias("_bn"))
    met = each.withColumn("_s", F.lower(plain)).join(byid, "character", "left").join(bysurface, "_s", "left")
    return met.select("chapter", "character", F.coalesce("_a", "_b", "character").alias("id"), F.coalesce("_an", "_bn", F.initcap(plain)).alias("name"), "place")


def migrated_roster(entries: DataFrame, lookup: DataFrame, group: str, drop: bool = False) -> DataFrame:
    """(group, place, id, surface): entries (group, place, surface) under their ids, each id once per group, at its first place.

    Entries that lookup (surface, id) does not know stay with a null id, or go where `drop` is set.
    """
    met = entries.join(lookup, "surface", "left")
    known = met.where("id IS NOT NULL").groupBy(group, F.lower("id").alias("_k")).agg(F.min(F.struct("place", "id", "surface")).alias("_x")).select(group, "_x.*")
    return known if drop else known.unionByName(met.where("id IS NULL").select(group, "place", "id", "surface"))
