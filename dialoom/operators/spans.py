"""Joins and alignments of half-open spans within documents."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dialoom.functions.scalars import overlap

BIN = 1024


def interval_of(points: DataFrame, intervals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """points (doc, at, ...) with `idx`: the interval (doc, idx, start, end; disjoint) that holds the point, else -1.

    One sort per document and no pairs: the last interval that starts at or before the point is looked back to.
    """
    names = points.columns
    a = points.select(doc, F.col("at").alias("_at"), F.lit(1).alias("_late"), F.struct(*names).alias("_row"), F.lit(None).cast("struct<end:int,idx:int>").alias("_open"))
    b = intervals.select(doc, F.col("start").alias("_at"), F.lit(0).alias("_late"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(F.col("end").cast("int").alias("end"), F.col("idx").cast("int").alias("idx")).alias("_open"))
    w = Window.partitionBy(doc).orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_found", F.last("_open", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    return both.select("_row.*", F.when(F.col("_found.end") > F.col("_at"), F.col("_found.idx")).otherwise(-1).alias("idx"))


def overlapping(left: DataFrame, right: DataFrame, doc: str = "doc_id", bin_size: int = BIN) -> DataFrame:
    """All pairs of left (doc, l, l_start, l_end) and right (doc, r, r_start, r_end) that overlap, with `shared`.

    Spans are dealt to bins of the text, and a pair counts in the bin where its overlap begins, so a long document is many
    small groups and no pair appears twice.
    """
    def bins(df: DataFrame, p: str) -> DataFrame:
        df = df.where(f"{p}_end > {p}_start")
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / bin_size), F.floor((F.col(f"{p}_end") - 1) / bin_size))))

    met = bins(left, "l").join(bins(right, "r"), [doc, "_bin"]).where("l_start < r_end AND r_start < l_end")
    met = met.where(F.floor(F.greatest("l_start", "r_start") / bin_size) == F.col("_bin"))
    return met.withColumn("shared", overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))).drop("_bin")


def best_overlap(pairs: DataFrame, doc: str = "doc_id", more: list | None = None) -> DataFrame:
    """For each left span the right one of most overlap; ties by `more`, then the first."""
    order = Window.partitionBy(doc, "l").orderBy(F.desc("shared"), *(more or []), "r")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def aligned(pairs: DataFrame, doc: str = "doc_id", least: float = 0.5, of_shorter: bool = True, ordered: bool = False) -> DataFrame:
    """One-to-one alignment of overlapping pairs, per document: (doc, l, r, shared).

    A pair is eligible if it shares `least` of the shorter (or of the left) span. Greedy: by coverage, overlap, l and r, all
    descending. Ordered: most matches, then most overlap, with neither side out of order. A document's pairs are one group.
    """
    whole = F.least(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start")) if of_shorter else F.col("l_end") - F.col("l_start")
    fit = pairs.select(doc, F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.col("shared").cast("long").alias("shared"), (F.col("shared") / whole).alias("cover")).where(F.col("cover") >= least)

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, out = set(), set(), []
        for row in rows.sort_values(["cover", "shared", "l", "r"], ascending=False).itertuples(index=False):
            if row.l not in left and row.r not in right:
                left.add(row.l)
                right.add(row.r)
                out.append((getattr(row, doc), row.l, row.r, row.shared))
        return pd.DataFrame(out, columns=[doc, "l", "r", "shared"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """The best chain of pairs that rise on both sides: best scores by r, in a Fenwick tree over ranks of r."""
        rank = {r: i + 1 for i, r in enumerate(sorted(rows["r"].unique()))}
        tree: list = [((0, 0), None)] * (len(rank) + 1)
        for _, same in rows.sort_values(["l", "r"]).groupby("l"):
            new = []
            for row in same.itertuples(index=False):
                best, k = ((0, 0), None), rank[row.r] - 1
                while k:
                    best, k = max(best, tree[k], key=lambda x: x[0]), k & (k - 1)
                new.append((rank[row.r], ((best[0][0] + 1, best[0][1] + row.shared), (row, best[1]))))
            for k, node in new:
                while k < len(tree):
                    tree[k] = max(tree[k], node, key=lambda x: x[0])
                    k += k & -k
        best, out = max(tree, key=lambda x: x[0])[1], []
        while best:
            row, best = best
            out.append((getattr(row, doc), row.l, row.r, row.shared))
        return pd.DataFrame(out[::-1], columns=[doc, "l", "r", "shared"])

    kind = pairs.schema[doc].dataType.simpleString()
    return fit.groupBy(doc).applyInPandas(chain if ordered else greedy, f"{doc} {kind}, l long, r long, shared long")


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The share of matching characters by longest common blocks; two empty texts are alike."""
    ratio = lambda a, b: 1.0 if not a and not b else difflib.SequenceMatcher(None, a or "", b or "").ratio()
    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    lists = ((list(a if a is not None else []), list(b if b is not None else [])) for a, b in zip(left, right))
    return pd.Series([1.0 if not a and not b else difflib.SequenceMatcher(None, a, b).ratio() for a, b in lists], dtype="float64")
