"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over the texts gives a dozen statistics per document, written to the shared folder. Labelled documents that are
not held out give counts, sums and sums of products per class as Spark aggregates (90 or so numbers for either class reach
the driver, whatever the input). Each class covariance is shrunk towards the pooled covariance and a scaled identity; its
Cholesky factor is computed once and used for every document: the score is the logistic of the log-density difference,
from Mahalanobis distances by triangular factors, plus the log prior odds.

All labelled rows are used, without a sample. Defined results: null and empty texts have all counts zero and are scored
like any other; labels other than 0 and 1 are left out; repeated label rows count as often as they stand; without labels
of both classes the score is (label 1 rows + 1) / (rows + 2) for all; an empty table gives no rows; statistics come from
the text only.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.shared import Scratch, slices, table

FEATURES = (
    "log_words", "type_token", "top_word", "repeats", "word_length", "word_spread",
    "upper", "digits", "stops", "symbols", "line_rate", "line_copies",
)
#: Words added to a text's own in shares of repetition, which in a few words mean little.
CALM = 40
TO_POOLED, TO_IDENTITY = 0.15, 0.03

#: Byte classes: 0 letters and bytes of other scripts, 1 upper case, 2 digits, 3 white space, 4 sentence marks, 5 other symbols.
CLASSES = np.zeros(256, np.uint8)
CLASSES[0:128] = 5
CLASSES[ord("a") : ord("z") + 1] = 0
CLASSES[ord("A") : ord("Z") + 1] = 1
CLASSES[ord("0") : ord("9") + 1] = 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 4


def _log(x: float) -> float:
    """Shares spread over orders of magnitude; below one in a hundred they hardly differ."""
    return math.log(x + 1e-2)


def statistics(text: str | None) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=6) if raw else np.zeros(6)
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0, 1.0, _log(0), _log(0), 0.0, 0.0, *[_log(0)] * 6)
    counts = Counter(words)
    repeats = sum(map(eq, words, islice(words, 1, None)))
    length = (len(raw) - int(kinds[3])) / n
    lengths = np.fromiter(map(len, counts), np.float64, len(counts))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = len(raw) - int(kinds[3])
    return (
        math.log1p(n),
        math.log(len(counts) + CALM) / math.log(n + CALM),
        _log((max(counts.values()) - 1) / (n + CALM)),
        _log(repeats / (n + CALM)),
        math.log(length),
        math.log(1.0 + float(lengths.std())),
        *(_log(int(kinds[k]) / solid) for k in (1, 2, 4, 5)),
        _log(len(lines) / n),
        _log(1 - len(set(lines)) / max(1, len(lines))),
    )


def _batches(batches, make, text: int):
    """make(rows) for slices of each batch; text: the place of the text column."""
    for batch in batches:
        yield from map(make, slices(batch, text))


def features(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, x array<double> in the order of FEATURES."""

    def one(part):
        rows = np.array([statistics(t) for t in part.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        ends = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
        return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, rows.ravel())], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _batches(batches, one, 1), f"doc_id {kind}, x array<double>")


def fit(featured: DataFrame, labels: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> dict:
    """featured: (doc_id, x); labels: (doc_id, label 0 or 1). The model: prior and, per class, mean and Cholesky factor."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    joined = featured.join(labels.where("label IN (0, 1)"), "doc_id").select("label", *(F.col("x")[i].alias(f"x{i}") for i in range(d)))
    sums = joined.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(f"x{i}") for i in range(d))).alias("sums"),
        F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs)).alias("products"),
    ).collect()  # two rows
    n = {r.label: r.n for r in sums}
    if len(n) < 2:
        return {"flat": (n.get(1, 0) + 1) / (sum(n.values()) + 2)}
    means, covs = {}, {}
    for r in sums:
        mean, cov = np.array(r.sums) / r.n, np.zeros((d, d))
        for (i, j), p in zip(pairs, r.products):
            cov[i, j] = cov[j, i] = p / r.n - mean[i] * mean[j]
        means[r.label], covs[r.label] = mean, cov
    pooled = sum(covs[k] * n[k] for k in n) / sum(n.values())
    model = {"prior": math.log(n[1] / n[0])}
    for k in n:
        cov = (1 - to_pooled - to_identity) * covs[k] + to_pooled * pooled + to_identity * max(np.trace(pooled) / d, 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        # the inverse factor turns every solve into one product; its diagonal gives the log determinant
        model[k] = (means[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """x: (rows, features) -> scores in [0, 1], higher where label 1 is likelier."""
    if "flat" in model:
        return np.full(len(x), model["flat"])
    density = {}
    for k in (0, 1):
        mean, inverse, log_root = model[k]
        density[k] = -0.5 * np.square((x - mean) @ inverse.T).sum(axis=1) - log_root
    z = np.clip(density[1] - density[0] + model["prior"], -700, 700)
    return 1.0 / (1.0 + np.exp(-z))


def held_out(id_column):
    """Rows that learning never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(featured: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality") -> dict:
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    return fit(featured, rows.where(~held_out(F.col("doc_id"))))


def scored(featured: DataFrame, model: dict) -> DataFrame:
    """featured (doc_id, x) -> doc_id, score."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(model, x))], ["doc_id", "score"])

    kind = featured.schema["doc_id"].dataType.simpleString()
    return featured.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: dict, least: float = 0.5, text_col="text") -> DataFrame:
    """The rows of docs, untouched, whose text scores `least` or more."""
    at = docs.columns.index(text_col)

    def one(part):
        x = np.array([statistics(t) for t in part.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        return part.filter(pa.array(score(model, x) >= least))

    return docs.mapInArrow(lambda batches: _batches(batches, one, at), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = Scratch(spark, "quality").table(features(table(spark, sf_dir, "documents")), "features")
    model = train(featured, table(spark, sf_dir, "labels"))
    return scored(featured, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
