"""Columns computed in Python, batch by batch, the other columns untouched.

Used where an algorithm is sequential inside one value.  A map over Arrow
batches is planned as one operator of its own, which also keeps its input
expressions from being evaluated twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


BATCH_BYTES = 4 << 20


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``BATCH_BYTES``, one row at least.

    Spark cuts batches by their rows; Python objects made of a batch of long
    texts would grow with the texts.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_column(
    df: DataFrame, out: str, data_type: T.DataType, inputs: Sequence[str], function: Callable
) -> DataFrame:
    """Set column ``out`` to ``function(*values)`` of each row's ``inputs``."""
    fields = [f for f in df.schema.fields if f.name != out] + [T.StructField(out, data_type)]
    schema = T.StructType(fields)
    names = [f.name for f in fields[:-1]]
    arrow_type = to_arrow_type(data_type)
    inputs = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values = [batch.column(c).to_pylist() for c in inputs]
            made = pa.array([function(*row) for row in zip(*values)], arrow_type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [made], names=names + [out]
            )

    return df.mapInArrow(run, schema).select(
        *(df.columns if out in df.columns else [*df.columns, out])
    )


def neighbours(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with one value of ``key``, as slices of the batches they lie in."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if rest and values[start] != last:
                yield rest
                rest = []
            rest.append(batch.slice(start, end - start))
            last = values[start]
    if rest:
        yield rest
