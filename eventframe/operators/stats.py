"""Latency and value distributions over pairs and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import LATENCY_QUANTILES, distribution, widen
from ..functions.text import int_div
from ..schema import as_column


def with_share(df: DataFrame) -> DataFrame:
    return df.withColumn("than_pct", int_div(F.col("than") * 100, "calls"))


def delay_stats(pairs: DataFrame, by: Sequence[str] = (), than: int | None = None, only_than: bool = False,
                sort: bool = False, exact: bool = True, wide: bool | None = False) -> DataFrame:
    """calls, total, min, p50, p95, p99, max per (start, end, by...); with ``than`` also its count and integer %.

    ``only_than`` gives no rows at all unless some pair exceeds the threshold (checked by a first job). ``wide``: as in ``distribution``.
    """
    if only_than and pairs.where(F.col("latency") > than).isEmpty():
        pairs = pairs.where(F.lit(False))
    out = distribution(pairs, [*by, "start", "end"], "latency", LATENCY_QUANTILES, than, exact, wide)
    if than is not None:
        out = with_share(out)
    return out.orderBy(*by, F.desc("total"), "start", "end") if sort else out


def num_dist(df: DataFrame, num: str | Column, by: Sequence[str] = (), than: int | None = None,
             exact: bool = True) -> DataFrame:
    """n, total, min, avg (integer), p99, max of a number per event type."""
    d = distribution(df, ["event", *by], num, {"p99": "0.99"}, than, exact)
    return d.withColumn("avg", int_div("total", "calls"))


def simple_stats(df: DataFrame, by: Sequence[str], value: str | Column, than: int | None = None,
                 calls: str = "calls", wide: bool = False, **extra: Column) -> DataFrame:
    """calls, total, min, avg (integer), max and optional threshold count: one map-side combined aggregation.

    ``wide=True`` returns the total as DECIMAL, for sums beyond 2^63.
    """
    v = as_column(value)
    aggs = [F.count(v).alias(calls), F.sum(widen(v, wide)).alias("total"), F.min(v).alias("min"), F.max(v).alias("max")]
    if than is not None:
        aggs.append(F.count_if(v > than).alias("than"))
    aggs += [c.alias(n) for n, c in extra.items()]
    return df.groupBy(*by).agg(*aggs).withColumn("avg", int_div("total", calls))


def syscall_stats(pairs: DataFrame, free: str | None = None, names: DataFrame | None = None,
                  by: Sequence[str] = (), than: int | None = None) -> DataFrame:
    """Per call id: calls, total, min, avg, max, err (return value in -4095..-1).

    ``pairs`` come from ``pair_events(..., carry=["call", "ret"])`` by thread. Enter and exit must agree on the id.
    A ``free`` event on the end level closes the thread's pending call without error. ``names``: id, name.
    """
    freed = F.lit(False) if free is None else F.col("end") == free
    rows = pairs.where(freed | (F.col("start_call") == F.col("end_call"))).select(
        *by, F.col("start_call").alias("id"), "latency",
        F.when(~freed & F.col("end_ret").between(-4095, -1), 1).otherwise(0).alias("failed"))
    out = simple_stats(rows, [*by, "id"], "latency", than, err=F.sum("failed"))
    if names is not None:
        out = out.join(names, "id", "left").withColumn("name", F.coalesce("name", F.col("id").cast("string")))
    return out


def heatmap(pairs: DataFrame, step: int, rows: int = 50, low: int = 0, time: str = "end_time",
            value: str = "latency") -> DataFrame:
    """Counts per (time column, value row). First time and highest value are one aggregated row read first."""
    kept = pairs.where(F.col(value) >= low)
    t0, high = kept.agg(F.min(time), F.max(value)).first()
    height = max(1, ((high or 0) - low) // rows)
    return kept.groupBy(
        F.expr(f"({time} - {t0 or 0}L) div {step}L").alias("col"),
        F.expr(f"({value} - {low}L) div {height}L").alias("row"),
    ).agg(F.count("*").alias("count"))


def threshold_share(df: DataFrame, by: Sequence[str], value: str, than: int) -> DataFrame:
    return with_share(df.groupBy(*by).agg(F.count("*").alias("calls"),
                                          F.count_if(F.col(value) > than).alias("than")))


def bitfield_dist(df: DataFrame, word: str | Column, fields: Mapping[str, tuple[int, int, Mapping[int, str]]],
                  weight: str | Column, than: int | None = None) -> DataFrame:
    """Decode bit fields ``name: (shift, width, {value: label})`` into a label, then weight statistics per label."""
    w = as_column(word).cast("bigint")
    labels = []
    for shift, width, names in fields.values():
        part = F.shiftright(w, shift).bitwiseAND(F.lit((1 << width) - 1))
        label = F.lit("N/A")
        for value, text in names.items():
            label = F.when(part == value, F.lit(text)).otherwise(label)
        labels.append(label)
    return simple_stats(df.withColumn("label", F.concat_ws(" ", *labels)), ["label"], weight, than, "samples")
