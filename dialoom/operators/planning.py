"""Plans of what is still to be spoken, and reviews of speakers outside the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIO = r"\.(wav|mp3|m4a|flac|ogg)$"  # fixed values: extensions of clips
NARRATOR = "narrator"


def pair_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pairs in both, left_only and right_only, over distinct keys."""
    a, b = (rows.select(*keys).distinct().withColumns({"_l": F.lit(l), "_r": F.lit(r)}) for rows, l, r in ((left, 1, 0), (right, 0, 1)))
    sides = a.unionAll(b).groupBy(*keys).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    return sides.agg(F.count_if(F.expr("l + r = 2")).alias("pairs"), F.count_if(F.expr("r = 0")).alias("left_only"), F.count_if(F.expr("l = 0")).alias("right_only"))


def with_audio(chapters: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """chapters (chapter, ...) with has_audio: a manifest (chapter, clips, total_clips, corrupt) lists clips, states a
    total or cannot be read, or a file (chapter, file) has a clip's extension."""
    listed = manifests.where(F.coalesce(F.col("corrupt"), F.lit(False)) | (F.col("clips") > 0) | (F.col("total_clips") > 0)).select("chapter")
    held = listed.unionAll(files.where(F.lower("file").rlike(AUDIO)).select("chapter")).distinct().withColumn("has_audio", F.lit(True))
    return chapters.join(held, "chapter", "left").withColumn("has_audio", F.coalesce("has_audio", F.lit(False)))


def chapter_batches(lines: DataFrame, voices: DataFrame, target: int) -> DataFrame:
    """Per chapter and character of the missing lines (chapter, character, chars): lines, chars, voice and under_target.

    voices: (character, voice), one row each; a character without one has a null voice and is under no target.
    """
    sums = lines.groupBy("chapter", "character").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"))
    under = F.col("voice").isNotNull() & (F.coalesce("chars", F.lit(0)) < target)
    return sums.join(voices, "character", "left").withColumn("under_target", under)


def character_plan(batches: DataFrame) -> DataFrame:
    """Per character with a voice: voice, lines, chars, chapters and how many of its chapters are under the target."""
    return batches.where("voice IS NOT NULL").groupBy("character", "voice").agg(
        F.sum("lines").alias("lines"), F.sum("chars").alias("chars"), F.count("*").alias("chapters"), F.count_if("under_target").alias("under_target"),
    )


def chapter_totals(batches: DataFrame) -> DataFrame:
    """Per chapter: batches and lines that can be queued, and lines whose character has no voice."""
    voiced = F.col("voice").isNotNull()
    return batches.groupBy("chapter").agg(
        F.count_if(voiced).alias("queued_batches"), F.coalesce(F.sum(F.when(voiced, F.col("lines"))), F.lit(0)).alias("queued_lines"),
        F.coalesce(F.sum(F.when(~voiced, F.col("lines"))), F.lit(0)).alias("missing_voice_lines"),
    )


def source_batches(items: DataFrame) -> DataFrame:
    """Per source of speech, over items (place, source, label, character, chapter, lines, chars): label and primary
    character of the first place, lines, chars, distinct characters and chapters. Readers sort by chars, then label."""
    return items.groupBy("source").agg(
        F.min_by("label", "place").alias("label"), F.min_by("character", "place").alias("primary"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"),
        F.count_distinct("character").alias("characters"), F.count_distinct("chapter").alias("chapters"),
    )


def assignments(manifests: DataFrame, names: DataFrame, voices: DataFrame, existing: DataFrame) -> DataFrame:
    """(character, voice) that manifests (place, name, version, provider_voice) add to the existing characters.

    Only manifests of version 2.0 with a voice; names: (name, character); voices: (provider_voice, voice, ord), of which
    the first counts. The first manifest that leads to a voice gives it.
    """
    first = voices.groupBy("provider_voice").agg(F.min_by("voice", "ord").alias("voice"))
    usable = manifests.where("version = '2.0' AND provider_voice <> ''").join(names, "name").join(existing.select("character"), "character", "left_anti")
    return usable.join(first, "provider_voice").groupBy("character").agg(F.min_by("voice", "place").alias("voice"))


def blocklist(predicted: DataFrame, gold: DataFrame, least: int = 2) -> DataFrame:
    """(speaker, n): predicted speakers of at least `least` lines that gold never names; no narrator, no empty names."""
    said = lambda rows: rows.select("speaker").where("speaker <> '' AND speaker <> 'Narrator'")
    counts = said(predicted).groupBy("speaker").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(said(gold).distinct(), "speaker", "left_anti")


def review_items(lines: DataFrame, known: DataFrame, order: str, character: Column, surface: Column, key, fits: Column | None = None) -> DataFrame:
    """Lines whose character and surface are both outside the catalogue's keys (known: key), each with its item.

    An item is a surface as `key` normalises it: item, its spelling and line where it is first seen, and its lines'
    count. Lines without a surface, the narrator's, and those that do not fit are no items. Rows stay rows: no lists.
    """
    rows = lines.withColumns({"_id": F.coalesce(key(character), F.lit("")), "item": F.coalesce(key(surface), F.lit("")), "_surface": F.trim(surface)})
    rows = rows.where((F.col("item") != "") & (F.col("item") != NARRATOR) & (F.col("_id") != NARRATOR))
    if fits is not None:
        rows = rows.where(fits)
    keys = known.where("key <> ''").select("key").distinct()
    for column in ("_id", "item"):
        rows = rows.join(keys.withColumnRenamed("key", column), column, "left_anti")
    items = rows.groupBy("item").agg(F.min_by("_surface", order).alias("spelling"), F.min(order).alias("first_line"), F.count("*").alias("lines"))
    return rows.drop("_id", "_surface").join(items, "item")
