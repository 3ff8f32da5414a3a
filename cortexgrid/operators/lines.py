"""Passes along lines of voxels: one axis at a time, many lines in one array operation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cortexgrid.operators.grid import KEY

#: Voxels of lines, filled up to the longest, that are worked on at once.
LINE_VOXELS = 1 << 20


def along(df: DataFrame, axis: str, value: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """df (KEY, value) with value, a double, as kernel makes it from its line along axis.

    kernel takes places and values of many lines, one a row, in the order of places; a null value is infinite, as are those
    that fill lines up to the longest, at places beyond. Results that are infinite become null. A line goes to one task.
    """
    rest = [k for k in KEY if k != axis]
    column = df.columns.index(axis)
    others = [df.columns.index(k) for k in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(rows.num_rows, bool)
            new[:1] = True
            for k in others:
                values = rows.column(k).combine_chunks() if rows.num_rows else rows.column(k)
                code = values.dictionary_encode().indices.to_numpy(zero_copy_only=False) if not pa.types.is_integer(values.type) or values.null_count else values.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            whole = rows.num_rows if last else int(first[-1])
            held[:] = [] if last else rows.slice(whole).to_batches()
            first = first[first < whole]
            sizes = np.diff(np.append(first, whole))
            order = np.argsort(sizes, kind="stable")  # lines of like length together
            place = rows.column(column).to_numpy()
            g = rows.column(value).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64) if rows.num_rows else np.zeros(0)
            g = np.where(np.isnan(g), np.inf, g)
            made = np.full(rows.num_rows, np.inf)
            while len(order):
                many = max(1, min(len(order), int(np.searchsorted(sizes[order] * np.arange(1, len(order) + 1), LINE_VOXELS, "right"))))
                own, order = order[:many], order[many:]
                n = int(sizes[own].max())
                at = first[own][:, None] + np.minimum(np.arange(n), sizes[own][:, None] - 1)
                beyond = np.arange(n) >= sizes[own][:, None]
                found = kernel(place[at] + np.where(beyond, np.arange(n) - sizes[own][:, None] + 1, 0), np.where(beyond, np.inf, g[at]))
                made[at[~beyond]] = found[~beyond]
            made = made[:whole]
            if whole:
                out = rows.slice(0, whole).set_column(column_of, value, pa.array(made, mask=np.isinf(made)))
                yield from out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LINE_VOXELS:
                yield from ready(False)
                size = sum(b.num_rows for b in held)
        if held:
            yield from ready(True)

    column_of = df.columns.index(value)
    return df.repartition(*rest).sortWithinPartitions(*rest, axis).mapInArrow(run, df.schema)
