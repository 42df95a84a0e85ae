"""Counting, slots, counters, ratios, gaps and data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_column
from .enrich import asof
from .timeline import prev, run_max, timeline

PIECE = 4096    # slots of a range that are listed together


def top(df: DataFrame, key: str | Column | None = None, by: Mapping[str, str | Column] | None = None,
        add: Mapping[str, str | Column] | None = None, name: str | Column | None = None, only_name: bool = False,
        n: int | None = None, sort: bool = True) -> DataFrame:
    """Sum (or count, with ``"1"``) columns per key, ordered by the ``by`` columns, the others, then the key.

    Without ``key`` rows are counted by thread, leaving out -1 (exited threads); a key of the user's keeps all its
    values, -1 and NULL too. ``only_name`` groups by name instead of key.
    """
    by, add = dict(by or {}), dict(add or {})
    rows = df.withColumn("key", as_column("_tid" if key is None else key))
    if key is None:
        rows = rows.where("key <> -1")
    group = ["key"]
    if name is not None:
        rows = rows.withColumn("name", F.coalesce(as_column(name), F.lit("NULL")))
        if only_name:
            group = ["name"]
    sums = [F.coalesce(F.sum(as_column(e)), F.lit(0)).alias(c) for c, e in {**by, **add}.items()]
    if name is not None and not only_name:
        sums.append(F.min("name").alias("name"))
    out = rows.groupBy(*group).agg(*sums)
    if sort:
        out = out.orderBy(*[F.desc(c) for c in [*by, *add]], *group)
    return out.limit(n) if n is not None else out


def event_matrix(df: DataFrame, key: str | Column, events: Sequence[str], name: str = "event") -> DataFrame:
    """One row per key, one count column per event type."""
    return df.groupBy(as_column(key).alias("key")).agg(
        *[F.count_if(F.col(name) == e).alias(e) for e in events])


def slot_counts(df: DataFrame, period: int, interval: int, by: str = "_cpu", name: str = "event") -> DataFrame:
    """inst, event, interval, slot, n: the non-empty cells."""
    t = F.col("_time")
    return df.groupBy(
        F.col(by).alias("inst"), F.col(name).alias("event"), F.expr(f"_time div {interval}L").alias("interval"),
        F.expr(f"(_time % {interval}L) div {period}L").cast("int").alias("slot"),
    ).agg(F.count(t).alias("n"))


def count_slots(df: DataFrame, period: int, interval: int, by: str = "_cpu", name: str = "event") -> DataFrame:
    """Histogram row of interval/period slots (empty ones 0), their sum and the busiest one."""
    cells = slot_counts(df, period, interval, by, name)
    width = -(-interval // period)
    held = F.map_from_entries(F.collect_list(F.struct("slot", "n")))   # at most interval / period entries
    out = cells.groupBy("inst", "event", "interval").agg(
        held.alias("_m"), F.sum("n").alias("sum"), F.max("n").alias("max"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                        lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("bigint")))
    return out.select("inst", "event", "interval", slots.alias("slots"), "sum", "max")


def count_pivot(df: DataFrame, interval: int, events: Mapping[str, str | None], by: str = "_cpu",
                name: str = "event") -> DataFrame:
    """Counts per (interval, instance), one column per event; NULL where the event is not attached to the instance.

    ``events`` maps an event to the predicate of the instances it is attached to (None: all).
    """
    aggs = []
    inst = F.col("inst")
    out = df.groupBy(F.expr(f"_time div {interval}L").alias("interval"), F.col(by).alias("inst"))
    for e in events:
        aggs.append(F.count_if(F.col(name) == e).alias(e))
    out = out.agg(*aggs)
    for e, attached in events.items():
        if attached is not None:
            out = out.withColumn(e, F.when(as_column(attached), F.col(e)))
    return out.select("interval", inst, *events)


def counter_delta(df: DataFrame, counter: str, by: Sequence[str] = ("_cpu",), max_rows: int | None = None,
                  delta: str = "delta") -> DataFrame:
    """Increment of a cumulative counter since the previous sample (from 0 at first); a decrease counts 0."""
    tl = timeline(df, by, max_rows=max_rows).scan(_was=prev(counter))
    grown = F.col(counter) - F.coalesce(F.col(f"_was.{counter}"), F.lit(0))
    return tl.rows().withColumn(delta, F.greatest(grown, F.lit(0))).drop("_was")


def ratio(df: DataFrame, num: str | Column, den: str | Column, by: Sequence[str], zero: float = 0.0,
          scale: float = 1.0) -> DataFrame:
    """sum(num) * scale / sum(den) per group; ``zero`` where the denominator is 0."""
    a, b = F.sum(as_column(num)), F.sum(as_column(den))
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(a * F.lit(scale), b), F.lit(zero)).alias("ratio"))


def hit_ratio(df: DataFrame, refs: str, misses: str, by: Sequence[str]) -> DataFrame:
    """(refs - misses) / refs when there are more refs than misses, else 0."""
    r, m = F.sum(refs), F.sum(misses)
    return df.groupBy(*by).agg(F.when(r > m, (r - m) / r).otherwise(F.lit(0.0)).alias("ratio"))


def cpu_util(df: DataFrame, cycles: str, khz: int, interval_ms: int, by: Sequence[str]) -> DataFrame:
    """Cycles used of those available in each interval, in percent."""
    return df.groupBy(*by).agg((F.sum(cycles) * 100.0 / F.lit(float(khz) * interval_ms)).alias("util"))


def preset_counts(df: DataFrame, events: Sequence[str], by: str = "_cpu", halved: Sequence[str] = (),
                  name: str = "event") -> DataFrame:
    """Counts of preset events per CPU plus a row for ALL; events that fire on entry and exit are halved."""
    counts = [F.count_if(F.col(name) == e).alias(e) for e in events]
    out = df.withColumn("_by", F.col(by)).rollup("_by").agg(*counts, F.grouping("_by").alias("_all"))
    cpu = F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("_by").cast("string"))
    return out.select(cpu.alias("cpu"), *[F.expr(f"`{e}` div 2").alias(e) if e in halved else e for e in events])


def ip_histogram(df: DataFrame, mode: str = "cpumode", ip: str = "ip", sort: bool = False) -> DataFrame:
    out = df.groupBy(F.col(mode).alias("mode"), F.col(ip).alias("ip")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "mode", "ip") if sort else out


def slots_where(df: DataFrame, condition: str | Column, events: Sequence[str], period: int, by: str = "_cpu",
                name: str = "event", fill: bool | str = False, max_rows: int | None = None) -> DataFrame:
    """Slots of each instance in which the condition over the event counts holds.

    ``fill`` also judges slots without any event between an instance's first and last one: True gives a row for each,
    "ranges" one row for all slots between two events, with the column ``last`` for the last slot of a row.
    """
    counts = df.groupBy(F.col(by).alias("inst"), F.expr(f"_time div {period}L").alias("slot")).agg(
        *[F.count_if(F.col(name) == e).alias(e) for e in events])
    if not fill:
        return counts.where(as_column(condition))
    tl = timeline(counts, "inst", order=("slot",), max_rows=max_rows).scan(_p=prev("slot"))
    own = F.struct("slot", F.col("slot").alias("last"), *events)
    empty = F.struct((F.col("_p.slot") + 1).alias("slot"), (F.col("slot") - 1).alias("last"),
                     *[F.lit(0).cast("bigint").alias(e) for e in events])
    items = F.when(F.col("_p.slot") < F.col("slot") - 1, F.array(empty, own)).otherwise(F.array(own))
    found = tl.rows().select("inst", F.explode(items).alias("r")).select("inst", "r.*").where(as_column(condition))
    if fill == "ranges":
        return found
    # Single slots in two steps, so that no array has all slots of a long range.
    pieces = found.withColumn("_from", F.explode(F.expr(f"sequence(slot, last, {PIECE}L)")))
    return pieces.select("inst", F.explode(F.sequence("_from", F.least(F.col("_from") + PIECE - 1, "last"))).alias("slot"), *events)


def gaps(df: DataFrame, by: str = "_cpu", than: int = 0, max_rows: int | None = None) -> DataFrame:
    """Consecutive events of an instance further apart than the threshold."""
    tl = timeline(df, by, max_rows=max_rows).scan(_p=prev("_time", "seq"))
    gap = F.col("_time") - F.col("_p._time")
    return tl.rows().where(gap > than).select(
        F.col(by).alias("inst"), F.col("_p.seq").alias("from_id"), F.col("seq").alias("to_id"),
        F.col("_p._time").alias("from_time"), F.col("_time").alias("to_time"), gap.alias("gap"))


def missing_heartbeat(beats: DataFrame, checks: DataFrame, limit: int, by: str = "_cpu",
                      max_rows: int | None = None) -> DataFrame:
    """Check times at which an instance's last heartbeat is older than the limit (no heartbeat yet is no alarm)."""
    table = beats.select(by, F.col("_time"), "seq", F.col("_time").alias("beat_time"))
    seen = asof(checks.select(by, "_time", "seq"), table, [by], ["beat_time"], max_rows=max_rows)
    age = F.col("_time") - F.col("beat_time")
    return seen.where(age > limit).select(F.col(by).alias("inst"), F.col("seq").alias("check_id"),
                                          F.col("_time").alias("check_time"), age.alias("age"))


def lost_events(df: DataFrame, counter: str, period: str | Column = "1", by: Sequence[str] = ("event", "_cpu"),
                max_rows: int | None = None) -> DataFrame:
    """Samples whose counter did not advance by one period: so many events less one were lost before them."""
    tl = timeline(df, by, max_rows=max_rows).scan(_p=prev(counter))
    before = F.col(f"_p.{counter}")
    step = F.col(counter) - before
    return tl.rows().where((before != 0) & (step != as_column(period))).select(
        *by, "seq", "_time", (step - 1).alias("lost"))


def disorder(df: DataFrame, by: str = "_cpu", arrival: str = "seq", max_rows: int | None = None) -> DataFrame:
    """Rows older than an event of the same instance that arrived before them."""
    tl = timeline(df, by, order=(arrival,), max_rows=max_rows).scan(_newest=run_max("_time"))
    return tl.rows().where(F.col("_time") < F.col("_newest")).select(
        F.col(by).alias("inst"), F.col(arrival).alias("seq"), "_time", (F.col("_newest") - F.col("_time")).alias("behind"))


def trace(df: DataFrame, columns: Sequence[str], where: str | Column | None = None) -> DataFrame:
    """Filtered event listing in time order (a range-partitioned sort)."""
    if where is not None:
        df = df.where(as_column(where))
    return df.orderBy("_time", "seq").select(*columns)


def interval_stats(df: DataFrame, interval: int, value: str | Column, by: Sequence[str] = ("event",)) -> DataFrame:
    """n, total, min, max per report interval: the batch twin of the streaming report."""
    v = as_column(value)
    return df.groupBy(F.expr(f"_time div {interval}L").alias("interval"), *by).agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"))
