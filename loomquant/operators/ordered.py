"""Ordered state machines over each symbol's rows in order of time; a kernel adds columns.

Only logic that no window frame expresses comes here; kernels get narrow frames and what they emit is aggregated
natively. `scan` streams: Spark sorts (and spills), and a kernel sees one Arrow batch at a time and keeps its state between
them, so memory does not follow the length of a symbol. `add_columns` is for the kernels that need a whole series at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
ARROW = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _starts(batch: pa.RecordBatch, by: list[str], last: list) -> tuple[np.ndarray, list]:
    """Rows of a batch at which another group begins, and the key of its last row."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    for c, before in zip(by, last, strict=True):
        keys = batch.column(batch.schema.get_field_index(c))
        same = pc.equal(keys[1:], keys[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        empty = keys.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (empty[1:] & empty[:-1]))
        new[0] |= before is _NOTHING or keys[0].as_py() != before
    return np.flatnonzero(new), [batch.column(batch.schema.get_field_index(c))[n - 1].as_py() for c in by]


_NOTHING = object()


def scan(df: DataFrame, start: Callable[[], Kernel], new: dict[str, T.DataType], *, by: list[str], order: list[str]) -> DataFrame:
    """`df` with the columns of a kernel that `start` makes for each group. The kernel is called with consecutive pieces of
    the group, sorted by `order`, and returns arrays of their length; NaN becomes null."""
    names = [*df.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kernel = [_NOTHING] * len(by), None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last = _starts(batch, by, last)
            edges = np.unique(np.concatenate([[0], starts, [batch.num_rows]]))
            parts: dict[str, list] = {name: [] for name in new}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a in starts:
                    kernel = start()
                piece = batch.slice(a, b - a)
                added = kernel({c: piece.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(piece.schema.names)})
                for name in new:
                    parts[name].append(added[name])
            arrays = [pa.array(np.concatenate(parts[n]), ARROW[t.simpleString()], from_pandas=True) for n, t in new.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in new.items())])
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def add_columns(df: DataFrame, kernel: Kernel, new: dict[str, T.DataType], *, by: list[str], order: list[str]) -> DataFrame:
    """`df` with the kernel's columns. The kernel sees each group's columns as arrays, sorted by `order`, and returns
    arrays of the same length; NaN becomes null."""
    fields = [*df.schema.fields, *(T.StructField(n, t) for n, t in new.items())]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order]).combine_chunks()
        columns = {c: table[c].to_numpy() for c in table.column_names}
        added = kernel(columns)
        for name, kind in new.items():
            table = table.append_column(name, pa.array(added[name], type=ARROW[kind.simpleString()], from_pandas=True))
        return table

    return df.groupBy(*by).applyInArrow(run, T.StructType(fields))
