"""Character statistics kept up by a stream: a chapter that comes again replaces its own counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators.aggregate import character_stats, counts_matrix


class StatsAccumulator:
    """Counts (character, chapter, n) at `path`, in files by the chapter's hash; a batch replaces what it knows of its chapters.

    Every batch adds its chapters' counts under its own number, with a row without a character for each chapter, so that one that
    has become empty loses its old counts. A chapter's latest batch is what counts; compact() leaves only that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def apply(self, lines: DataFrame, batch_id: int = 0) -> None:
        """lines (character, chapter): whole chapters. The same batch again gives the same table."""
        seen = lines.select(F.lit(None).cast("string").alias("character"), F.col("chapter").cast("string").alias("chapter"), F.lit(0).cast("long").alias("n")).where("chapter IS NOT NULL").distinct()
        matrix = counts_matrix(lines, F.col("character"), F.col("chapter").cast("string")).where("chapter IS NOT NULL")
        rows = matrix.unionByName(seen).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def _matrix(self) -> DataFrame:
        rows = self.spark.read.schema("character string, chapter string, n long, batch long").parquet(self.path)
        latest = rows.groupBy("chapter").agg(F.max("batch").alias("batch"))
        return rows.join(latest, ["chapter", "batch"]).where("character IS NOT NULL").select("character", "chapter", "n")

    def stats(self) -> DataFrame:
        return character_stats(self._matrix())

    def compact(self, path: str) -> StatsAccumulator:
        """A copy at another path with one row per character and chapter, as batch -1."""
        self._matrix().withColumn("batch", F.lit(-1).cast("long")).write.mode("overwrite").partitionBy("batch").parquet(path)
        return StatsAccumulator(self.spark, path)

    def follow(self, stream: DataFrame, checkpoint: str):
        """A query that applies all that the stream holds now and ends."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after that are new or differ."""
    old = before.select("character", F.struct("total_lines", "chapter_count").alias("_old"))
    return after.join(old, "character", "left").where(~F.struct("total_lines", "chapter_count").eqNullSafe(F.col("_old"))).drop("_old")
