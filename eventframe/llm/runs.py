"""Rows of one key that arrive one after the other, across Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables with whole runs of equal keys (as sorted partitions have them), and the bounds of each run."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        starts = _starts(table, keys)
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), list(zip(starts[:-1], starts[1:], strict=True))
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), [(0, rest.num_rows)]


def _starts(table: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new).tolist()


def by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame with the rows of each key together in one task, one after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
