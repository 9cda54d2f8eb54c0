"""Folds over sorted groups in Python, many small groups to one call."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

ROWS = 8192  # rows of a batch that is handed back


def _cells(column: pa.Array) -> list:
    if pa.types.is_nested(column.type) or column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def folded(rows: DataFrame, group: str, order: list[str], fold: Callable[[object, list[tuple]], Iterable[tuple]], schema: StructType) -> DataFrame:
    """Rows of schema that fold(key, rows) gives for each group, whose rows come as tuples without the group and in order.

    A task's groups follow one another in sorted partitions, so that a group costs no call of its own; one group is held at a time.
    Rows that are dealt by the group already are not dealt again.
    """
    columns = [c for c in rows.columns if c != group]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            keys = _cells(batch.column(0))
            cells = list(zip(*map(_cells, batch.columns[2:])))
            at = 0
            for begin in np.flatnonzero(batch.column(1).to_numpy() == 1).tolist():
                held.extend(cells[at:begin])
                if held:
                    out.extend(fold(key, held))
                key, held, at = keys[begin], [], begin
                if len(out) >= ROWS:
                    yield made(out)
                    out = []
            held.extend(cells[at:])
        if held:
            out.extend(fold(key, held))
        if out:
            yield made(out)

    number = F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("_n")
    return rows.select(group, number, *columns).mapInArrow(run, schema)
