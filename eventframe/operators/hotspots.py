"""Samples of busy seconds: windows anchored at the first sample after the previous window ended."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ORDER, UNIT_NS, join_same
from .timeline import CHUNK, run_sum, timeline

NONE = -1


def hot_seconds(df: DataFrame, freq: int, pct: int, by: str = "_cpu", second: int = UNIT_NS["s"],
                anchored: bool = True, max_rows: int | None = None) -> DataFrame:
    """Samples from the ceil(freq * pct / 100)-th on in each second of an instance: inst, seq, _time, nth.

    Anchored seconds start at a sample (which is never reported itself). Their chain is sequential, so it runs in
    numpy per instance; of a hot instance each chunk is first reduced to "last anchor for every possible first
    anchor" - only samples of the chunk's first second can be that - and the few summaries are chained.
    ``anchored=False`` uses calendar seconds and stays in the JVM.
    """
    need = -(-freq * pct // 100)
    slim = df.select(F.col(by).alias("inst"), *ORDER)
    if not anchored:
        cells = slim.withColumn("_second", F.expr(f"_time div {second}L"))
        counted = timeline(cells, ["inst", "_second"], max_rows=max_rows).scan(nth=run_sum(F.lit(1))).rows()
        return counted.where(F.col("nth") >= need).select("inst", "seq", "_time", "nth")

    inst_type = slim.schema["inst"].dataType.simpleString()
    tl = timeline(slim, "inst", max_rows=max_rows)
    result = f"inst {inst_type}, seq bigint, _time bigint, nth bigint"
    if not tl.cut:
        return tl.frame.groupBy("inst").applyInPandas(lambda rows: _report(rows, second, need), result)

    def summarize(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["_time"].to_numpy())
        final = _last_anchor(t, second)
        first = np.arange(min(len(t), int(np.searchsorted(t, t[0] + second)) + 1))
        return pd.DataFrame({
            "inst": [rows["inst"].iloc[0]], CHUNK: [rows[CHUNK].iloc[0]], "rows": [len(t)],
            "entries": [t[first]], "anchors": [t[final[first]]], "tails": [len(t) - final[first]]})

    def chain(parts: pd.DataFrame) -> pd.DataFrame:
        anchor, count, out = NONE, 0, []
        for p in parts.sort_values(CHUNK).itertuples(index=False):
            out.append((p.inst, p[1], anchor, count))
            i = 0 if anchor == NONE else int(np.searchsorted(p.entries, anchor + second))
            if i < len(p.entries):
                anchor, count = int(p.anchors[i]), int(p.tails[i])
            else:
                count += p.rows
        return pd.DataFrame(out, columns=["inst", CHUNK, "_anchor", "_count"])

    hot = tl.frame.where(F.col(CHUNK).isNotNull())
    parts = hot.groupBy("inst", CHUNK).applyInPandas(
        summarize, f"inst {inst_type}, {CHUNK} int, rows bigint, entries array<bigint>, anchors array<bigint>, "
                   f"tails array<bigint>")
    starts = parts.groupBy("inst").applyInPandas(
        chain, f"inst {inst_type}, {CHUNK} int, _anchor bigint, _count bigint")
    rows = join_same(tl.frame, starts, ["inst", CHUNK], "left", broadcast=True)
    rows = rows.na.fill({"_anchor": NONE, "_count": 0})
    return rows.groupBy("inst", CHUNK).applyInPandas(lambda r: _report(r, second, need), result)


def _last_anchor(t: np.ndarray, second: int) -> np.ndarray:
    """For every index as first anchor: the index of the last anchor of its chain (pointer doubling)."""
    own = np.arange(len(t))
    jump = np.searchsorted(t, t + second)
    hop = np.where(jump < len(t), jump, own)
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            return hop
        hop = further


def _report(rows: pd.DataFrame, second: int, need: int) -> pd.DataFrame:
    rows = rows.sort_values(list(ORDER), ignore_index=True)
    t = rows["_time"].to_numpy()
    anchor = int(rows["_anchor"].iloc[0]) if "_anchor" in rows else NONE
    before = int(rows["_count"].iloc[0]) if "_count" in rows else 0
    jump = np.searchsorted(t, t + second)
    i = 0 if anchor == NONE else int(np.searchsorted(t, anchor + second))
    begin = np.full(len(t), -before, dtype=np.int64)   # index at which the row's second began
    is_anchor = np.zeros(len(t), dtype=bool)
    while i < len(t):
        is_anchor[i] = True
        begin[i:jump[i]] = i
        i = int(jump[i])
    nth = np.arange(len(t)) - begin + 1
    keep = ~is_anchor & (nth >= need)
    return pd.DataFrame({"inst": rows["inst"][keep], "seq": rows["seq"][keep], "_time": t[keep], "nth": nth[keep]})
