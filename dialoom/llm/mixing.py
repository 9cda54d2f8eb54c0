"""Mixing sources to target weights, with DataFrame operations only.

Words are counted per document and summed per source (partial sums come before the shuffle, so a hot source is one row
per task). Each source's target is its weight's share of all words, stopped at `max_repeat` times what it has; the excess
goes to the others by weight until none is above. That fixed point is found in closed form: sources ordered by the share
at which they fill up, with running sums of caps and weights. Ranks and running sums over sources are taken in two steps, within
ranges of sources and over the ranges' totals, so that sources may be very many. A document is then emitted floor(target / size) times, plus
once more if a hash of the seed and its id falls below the fraction.

Defined results: null text counts no words and is emitted as often as its source's rate says, taking 0 words; a null
source is a source of its own, ordered last; repeated rows are each counted and share one decision per id; an empty table
gives an empty mix; a source without words has target 0. Columns other than the id, text and source are kept untouched
by mix() and never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.shared import WORD_PATTERN, Scratch, table

WEIGHTS = (5, 2, 1)


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """df with running sums up to and with each row in the given order, which tells all rows apart."""
    ranged = scratch.table(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    mine = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, "_range").withColumns({k: F.sum(c).over(mine) + F.col(f"_{k}") for k, c in sums.items()}).drop("_range", *(f"_{k}" for k in sums))


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """sizes: (source, size) -> (source, source_size, target), one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    per = _running(per, [by_name], {"place": F.lit(1)}, scratch)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")).drop("place")
    per = per.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    # in the order in which sources fill up; within a tie any order gives the same targets
    per = _running(per.withColumn("fills_at", F.col("cap") / F.col("weight")), [F.col("fills_at").asc(), by_name], {"caps": F.col("cap"), "weights": F.col("weight")}, scratch)
    per = scratch.table(per, "filling")
    whole = per.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))
    per = per.join(F.broadcast(whole))  # one row
    weights_left, caps_before = F.col("all_weights") - F.col("weights") + F.col("weight"), F.col("caps") - F.col("cap")
    per = per.withColumn("full", F.col("cap").cast("double") * weights_left <= F.col("weight").cast("double") * (F.col("total") - caps_before))
    open_ = per.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).alias("full_caps"), F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).alias("open_weights"))
    per = per.join(F.broadcast(open_))  # one row
    share = (F.col("weight") * (F.col("total") - F.col("full_caps"))).cast("double") / F.nullif("open_weights", F.lit(0)).cast("double")
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mixture(docs: DataFrame, weights=WEIGHTS, max_repeat: int = 3, seed: str = "mix", id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    sized = scratch.table(sized, "sizes")  # so that texts are read once
    targets = source_targets(sized, scratch, weights, max_repeat).withColumnRenamed("source", "of_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)).cast("double"), F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    copies = F.floor("rate") + (unit_hash(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = 3, seed: str = "mix", id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mixed corpus: every row of docs, whole and with all its columns, as many times as the mix takes it."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    names = {name: F.col("row").getField(name) for name in (id_col, text_col, source_col)}
    targets = source_targets(
        row.select(names[source_col].alias("source"), F.coalesce(F.regexp_count(names[text_col], F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")),
        Scratch(docs.sparkSession, "mixing"), weights, max_repeat,
    )
    joined = row.join(targets, names[source_col].eqNullSafe(F.col("source")))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)).cast("double"), F.lit(0.0))
    joined = joined.select("row", rate.alias("rate"))
    copies = F.floor("rate") + (unit_hash(names[id_col], seed) < F.col("rate") - F.floor("rate")).cast("long")
    # the copies are dealt by generate, row by row: a text repeated n times is never held n times at once
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM per),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps_before,
    CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights_left
  FROM ranked),
flagged AS (
  SELECT *, CAST(cap AS DOUBLE) * weights_left <= CAST(weight AS DOUBLE) * (total - caps_before) AS is_full FROM filled),
summed AS (
  SELECT *, CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS BIGINT) AS caps,
    CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS BIGINT) AS weights_open FROM flagged),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (total - caps) AS DOUBLE) / CAST(weights_open AS DOUBLE) END AS target FROM summed),
rated AS (
  SELECT doc_id, size, source_size, target, coalesce(target / CAST(nullif(source_size, 0) AS DOUBLE), 0.0) AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
