"""Catalogues of surfaces, and joins to them: unique, last-wins, unmatched, reconciled, carried forward, remapped.

A surface table has one row per spelling: (surface, id, ord). Lookups reduce it to one row per surface before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surfaces(records: DataFrame, id_col: str, spellings: list[Column], order: Column, key) -> DataFrame:
    """(surface, id, ord): every spelling of every record, as `key` normalises it; empty and null ones left out."""
    rows = records.select(F.col(id_col).alias("id"), order.alias("ord"), F.explode(F.array_distinct(F.array(*spellings))).alias("surface"))
    return rows.select(key(F.col("surface")).alias("surface"), "id", "ord").where("surface IS NOT NULL AND surface <> ''").distinct()


def last_wins(found: DataFrame) -> DataFrame:
    """(surface, id): the record of the highest order, then id."""
    return found.groupBy("surface").agg(F.max_by("id", F.struct("ord", "id")).alias("id"))


def unique(found: DataFrame) -> DataFrame:
    """(surface, id) of surfaces that one record alone has."""
    return found.groupBy("surface").agg(F.min("id").alias("id"), F.max("id").alias("most")).where("id = most").drop("most")


def ambiguous(found: DataFrame) -> DataFrame:
    return found.groupBy("surface").agg(F.count_distinct("id").alias("owners")).where("owners > 1")


def resolve(rows: DataFrame, lookup: DataFrame, surface: Column, name: str) -> DataFrame:
    """rows with column `name`: the id of the surface, null if there is none."""
    return rows.withColumn("_s", surface).join(lookup.select(F.col("surface").alias("_s"), F.col("id").alias(name)), "_s", "left").drop("_s")


def missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def reconcile(listed: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: kept in both, added (present only), removed (listed only)."""
    a, b = listed.select(*keys).distinct().withColumn("_l", F.lit(True)), present.select(*keys).distinct().withColumn("_p", F.lit(True))
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_p").isNull(), "removed").otherwise("kept")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def carried_forward(wanted: DataFrame, history: DataFrame, key: str, when: Column, value: Column) -> DataFrame:
    """wanted with `carried`: each key's value of the latest `when`, null without history."""
    latest = history.groupBy(key).agg(F.max_by(value, when).alias("carried"))
    return wanted.join(latest, key, "left")


def upsert(existing: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All keys of both; existing values win where not null; `change` says new, filled or kept."""
    a, b = existing.alias("a"), found.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    filled = F.lit(False)
    for c in columns:
        filled = filled | (F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNotNull())
    change = F.when(F.col(f"a.{key}").isNull(), "new").when(filled, "filled").otherwise("kept")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns), change.alias("change"))


def survivors(rows: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """One row per key, the first by `best`; `copies` counts the group."""
    group = Window.partitionBy(*keys)
    return rows.withColumns({"_r": F.row_number().over(group.orderBy(*best)), "copies": F.count("*").over(group)}).where("_r = 1").drop("_r")


def violations(rows: DataFrame, id_col: str, surface: Column, file: Column | None = None) -> DataFrame:
    """(rule, value, n): ids that are missing or repeat without regard to case, surfaces with several owners, and, if given, files of several owners."""
    base = rows.select(F.lower(F.trim(F.col(id_col).cast("string"))).alias("id"), surface.alias("surface"), F.lower(file if file is not None else F.lit(None).cast("string")).alias("file"))
    gone = base.where("id IS NULL OR id = ''").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("missing_id").alias("rule"), F.lit("").alias("value"), "n")
    twice = base.where("id <> ''").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").alias("value"), "n")

    def owned(key: str, rule: str) -> DataFrame:
        found = base.where(f"{key} <> ''").groupBy(key).agg(F.count_distinct("id").alias("n")).where("n > 1")
        return found.select(F.lit(rule).alias("rule"), F.col(key).alias("value"), "n")

    found = gone.unionAll(twice).unionAll(owned("surface", "ambiguous_surface"))
    return found if file is None else found.unionAll(owned("file", "file_collision"))
