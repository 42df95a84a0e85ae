"""Ordered scans per key that stay balanced when one key holds much of the data.

A plain window puts all rows of a key into one task. Here one job over a sample of the key columns looks for keys
with more rows than a task should hold. When there are none - the usual case - scans are plain windows. Otherwise
only the hot keys are cut into consecutive chunks of their own timeline, windows run per (key, chunk), and what a
chunk needs from the rows before it (last row, running sum/min/max) comes from one small row per chunk.

The cut points are fixed values once found, so a recomputed task always sees the same chunks. They affect balance
only, never a result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ORDER, as_column, join_same
from ..shared import stored

CHUNK = "_chunk"
MAX_ROWS = 4_000_000    # rows of one key a single task may hold
MAX_HOT = 10_000        # upper bound on hot keys, and on chunks beyond one per hot key
MARKS_PER_CHUNK = 64    # sampled positions per chunk from which cut points are chosen
SHOWS = 4_096           # sampled rows by which a key of MAX_ROWS rows is recognised


@dataclass(frozen=True)
class Scan:
    """One running column: kind is ``prev``, ``last``, ``sum``, ``min`` or ``max``."""

    kind: str
    value: Column


def prev(*columns: str) -> Scan:
    """The named columns of the previous row as a struct, NULL on the first row."""
    return Scan("prev", F.struct(*columns))


def last(value: str | Column) -> Scan:
    """Latest non-NULL value up to and including the row."""
    return Scan("last", as_column(value))


def run_sum(value: str | Column) -> Scan:
    return Scan("sum", as_column(value))


def run_min(value: str | Column) -> Scan:
    return Scan("min", as_column(value))


def run_max(value: str | Column) -> Scan:
    return Scan("max", as_column(value))


_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {
    "sum": lambda carry, here: F.coalesce(carry + here, here, carry),
    "min": F.least,
    "max": F.greatest,
}


@dataclass(frozen=True)
class Timeline:
    """An events frame with a key, an order, and (for hot keys only) a chunk number."""

    frame: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    cut: bool
    bounded: bool = True    # carried rows are few enough to broadcast
    scanned: bool = False   # the frame already holds a scan over chunks

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Timeline:
        """Filter rows or add columns; key, order and chunk columns must be kept."""
        return replace(self, frame=fn(self.frame))

    def rekey(self, *extra: str) -> Timeline:
        """A finer key (same rows split further): the chunks stay valid."""
        return replace(self, key=self.key + extra, bounded=False)

    def window(self) -> WindowSpec:
        """Window over the rows of a key (of a chunk, when hot keys are cut)."""
        parts = [*self.key, CHUNK] if self.cut else list(self.key)
        return Window.partitionBy(*(parts or [F.lit(0)])).orderBy(*self.order)

    def scan(self, **scans: Scan) -> Timeline:
        """Add running columns.

        Chunks read the frame twice (rows and carried values). A second scan over chunks therefore starts from a
        stored copy, so that the work adds up instead of doubling with every scan.
        """
        if self.cut and self.scanned:
            return replace(self, frame=stored(self.frame, "timeline"), scanned=False).scan(**scans)
        w = self.window()
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {}
        for name, s in scans.items():
            if s.kind == "prev":
                local[name] = F.lag(s.value).over(w)
            elif s.kind == "last":
                local[name] = F.last(s.value, ignorenulls=True).over(upto)
            else:
                local[name] = _AGGREGATE[s.kind](s.value).over(upto)
        out = self.frame.withColumns(local)
        if not self.cut:
            return replace(self, frame=out)
        carried = join_same(out, self._carry(scans), [*self.key, CHUNK], "left", broadcast=self.bounded)
        merged = {}
        for name, s in scans.items():
            carry, here = F.col(f"__c_{name}"), F.col(name)
            combine = _COMBINE.get(s.kind)
            merged[name] = combine(carry, here) if combine else F.coalesce(here, carry)
        done = carried.withColumns(merged).drop(*[f"__c_{n}" for n in scans])
        return replace(self, frame=done, scanned=True)

    def _carry(self, scans: dict[str, Scan]) -> DataFrame:
        """Per (hot key, chunk): what the earlier chunks leave behind; at most 2 * MAX_HOT rows unless rekeyed."""
        at = F.struct(*self.order)
        aggs = []
        for name, s in scans.items():
            if s.kind in _AGGREGATE:
                agg = _AGGREGATE[s.kind](s.value)
            else:
                known = s.value.isNotNull() if s.kind == "last" else F.lit(True)
                agg = F.max_by(F.struct(s.value.alias("v")), F.when(known, at))
            aggs.append(agg.alias(f"__c_{name}"))
        per_chunk = self.frame.where(F.col(CHUNK).isNotNull()).groupBy(*self.key, CHUNK).agg(*aggs)
        w = Window.partitionBy(*self.key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        out = {}
        for name, s in scans.items():
            c = F.col(f"__c_{name}")
            if s.kind in _AGGREGATE:
                out[f"__c_{name}"] = _AGGREGATE[s.kind](c).over(w)
            else:
                out[f"__c_{name}"] = F.last(c, ignorenulls=True).over(w)["v"]
        return per_chunk.withColumns(out)

    def rows(self) -> DataFrame:
        """The frame without the chunk column."""
        return self.frame.drop(CHUNK)


def timeline(df: DataFrame | Timeline, key: Sequence[str] | str, order: Sequence[str] = ORDER,
             max_rows: int | None = None) -> Timeline:
    """Order the rows of each key, cutting keys that exceed ``max_rows`` rows.

    Runs one job over a sample of the key columns, and two small ones when hot keys exist. An empty key means one
    global order.
    """
    if isinstance(df, Timeline):
        return df
    keys = (key,) if isinstance(key, str) else tuple(key)
    order = tuple(order)
    cuts = _find_cuts(df, keys, order, max_rows or MAX_ROWS)
    if cuts is None:
        return Timeline(df, keys, order, cut=False)
    table, longest = cuts
    chunk = F.when(F.col("__cuts").isNotNull(), position("__cuts", F.struct(*order), longest))
    if keys:
        frame = join_same(df, table, keys, "left", broadcast=True)
    else:
        # One global order: the cut points become a constant of the plan (integers only).
        only = [dict(zip(order, c)) for c in table.first()["__cuts"]]
        kind = table.schema["__cuts"].dataType.simpleString()
        frame = df.withColumn("__cuts", F.from_json(F.lit(json.dumps(only)), kind))
    return Timeline(frame.withColumn(CHUNK, chunk).drop("__cuts"), keys, order, cut=True)


def position(sorted_array: str | Column, x: Column, longest: int) -> Column:
    """How many entries of an ascending array are <= x: binary search in O(log n) inside the JVM."""
    a = F.col(sorted_array) if isinstance(sorted_array, str) else sorted_array
    steps = [1 << i for i in reversed(range(max(longest, 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(F.get(a, pos + step - 1) <= x, pos + step).otherwise(pos),
    )


def _find_cuts(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...],
               max_rows: int) -> tuple[DataFrame, int] | None:
    """Cut points of the hot keys: (table of key and ``__cuts``, longest list), or None.

    Sizes are estimated from a row sample in which a full task's worth of a key shows some SHOWS rows, so the job
    reads the key columns and shuffles next to nothing. Only the placement of rows depends on it.
    """
    step = max(1, max_rows // SHOWS)
    seen = df.select(*key)
    sizes = (seen if step == 1 else seen.sample(1 / step, seed=1)).groupBy(*key).agg(F.count("*").alias("__n"))
    total, largest = sizes.agg(F.sum("__n"), F.max("__n")).first()
    # More than total / MAX_HOT sampled rows each, so fewer than MAX_HOT keys qualify.
    limit = max(max_rows // step, -(-(total or 0) // MAX_HOT))
    if not largest or largest <= limit:
        return None
    mark_step = max(1, limit * step // MARKS_PER_CHUNK)
    marks = df
    if key:
        hot = sizes.where(F.col("__n") > limit).select(*key)
        marks = join_same(df, hot, key, "left_semi", broadcast=True)
    marks = marks.select(*key, *order)
    marks = marks if mark_step == 1 else marks.sample(1 / mark_step, seed=2)
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy(*order)
    chosen = (
        marks.withColumn("__i", F.row_number().over(w))
        .where(F.col("__i") % max(1, limit * step // mark_step) == 0)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__cuts"))
    )
    found = chosen.collect()   # fewer than MAX_HOT rows, with about MAX_HOT cut points in all
    if not found:
        return None
    schema = T.StructType(chosen.schema.fields)
    return df.sparkSession.createDataFrame(found, schema), max(len(r["__cuts"]) for r in found)
