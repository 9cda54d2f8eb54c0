"""What several corpus operators need: shared storage, table reading, words."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters, and what is not white space.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"

#: A-Z and a-z, for lower-casing ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="dialoom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows, and bytes of text, that a worker takes at once; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 22


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """Parts of an Arrow batch, in order, of so many rows and bytes of a text column at most."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for end, n in enumerate(lengths):
        if end > start and (held + n > size or end - start >= rows):
            yield batch.slice(start, end - start)
            start, held = end, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of an action are deleted when it ends, rather than when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/dialoom-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        with shuffles_dropped(self.spark):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table from table() that nothing reads any more."""
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/dialoom-" in folder:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)
