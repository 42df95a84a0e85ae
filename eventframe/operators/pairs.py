"""Start/end pairing of events by key.

Levels are ordered lists of event names. A row may start a pair (bit 0 of its role, not on the last level unless
cyclic) and may end one (bit 1, not on the first level unless cyclic). At most one start is open per key: any row
that may end a pair takes it, any row that may start one replaces it. So after dropping rows that can do neither, the
partner of a row is its direct predecessor in (key, time, arrival) order - one ordered scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ORDER, as_column, per_event
from .timeline import Timeline, last, position, prev, run_sum, timeline

RECLAIMED = -9          # level of events that end a start without a pair; adjacent to none
LITERAL_RANGES = 1000   # lost ranges up to this number travel inside the plan


def level_of(levels: Sequence[Sequence[str]], name: str = "event") -> Column:
    out = F.lit(None).cast("int")
    for i, events in reversed(list(enumerate(levels))):
        out = F.when(F.col(name).isin(list(events)), F.lit(i)).otherwise(out)
    return out


def roles(df: DataFrame, levels: Sequence[Sequence[str]], key: str | Column | Mapping = "_tid",
          role: str | Column | Mapping | None = None, cycle: bool = False, name: str = "event",
          untraced: Sequence[str] = (), reclaim: Sequence[str] = ()) -> DataFrame:
    """Traced rows with ``key``, ``_level``, ``_ends`` and ``_starts``.

    ``reclaim`` events (the owner's exit) take an open start without making a pair.
    """
    traced = [[e for e in level if e not in untraced] for level in levels]
    if not all(traced):
        raise ValueError("every level needs at least one traced event")
    final = len(levels) - 1
    bits = F.lit(3) if role is None else F.coalesce(per_event(role, name, F.lit(3)), F.lit(3))
    bits = bits.cast("int")
    gone = F.col(name).isin(list(reclaim)) if reclaim else F.lit(False)
    rows = df.where(F.col(name).isin([e for level in traced for e in level] + list(reclaim))).withColumns(
        {"key": per_event(key, name), "_level": F.when(gone, F.lit(RECLAIMED)).otherwise(level_of(traced, name))})
    level = F.col("_level")
    starts = ~gone & (bits.bitwiseAND(1) != 0) & (F.lit(cycle) | (level != final))
    ends = gone | ((bits.bitwiseAND(2) != 0) & (F.lit(cycle) | (level != 0)))
    return rows.withColumns({"_starts": starts, "_ends": ends}).where("_starts OR _ends")


def mark_lost(df: DataFrame, lost: DataFrame, instance: str | None = None) -> DataFrame:
    """Apply disjoint lost ranges ``(start_time, end_time[, instance])``.

    Rows strictly inside a range are dropped; rows at its start can end but not start a pair; ``_segment`` counts
    the ranges that ended before. Without ``instance`` a range affects everything.
    """
    few = None if instance else lost.select("start_time", "end_time").orderBy("start_time").limit(
        LITERAL_RANGES + 1).collect()
    if few is not None and len(few) <= LITERAL_RANGES:
        starts = F.array(*[F.lit(r[0]).cast("bigint") for r in few])
        ends = F.array(*[F.lit(r[1]).cast("bigint") for r in few])
        at = position(starts, F.col("_time"), len(few)) if few else F.lit(0)
        marked = df.withColumns({
            "_n": at.cast("bigint"), "_from": F.get(starts, at - 1), "_to": F.get(ends, at - 1)})
    else:
        by = [instance] if instance else []
        w = lost.select(*by, F.col("start_time").alias("_time"), F.lit(-1).cast("bigint").alias("seq"),
                        F.lit(1).alias("_is_lost"), F.struct("start_time", "end_time").alias("_range"))
        both = df.withColumn("_is_lost", F.lit(0)).unionByName(w, allowMissingColumns=True)
        tl = timeline(both, by).scan(_last=last("_range"), _n=run_sum("_is_lost"))
        marked = tl.rows().where("_is_lost = 0").withColumns(
            {"_from": F.col("_last.start_time"), "_to": F.col("_last.end_time")}
        ).drop("_is_lost", "_range", "_last")
    t = F.col("_time")
    inside = F.coalesce((F.col("_from") < t) & (t < F.col("_to")), F.lit(False))
    edge = F.coalesce(F.col("_from") == t, F.lit(False))
    passed = F.coalesce(F.col("_to") <= t, F.lit(True))
    out = marked.where(~inside).withColumn("_segment", F.when(passed, F.col("_n")).otherwise(F.col("_n") - 1))
    if "_starts" in df.columns:
        out = out.withColumn("_starts", F.col("_starts") & ~edge).where("_starts OR _ends")
    return out.drop("_n", "_from", "_to")


def pair_timeline(df: DataFrame, levels, key="_tid", role=None, cycle=False, name="event", untraced=(),
                  lost: DataFrame | None = None, lost_by: str | None = None, carry: Sequence[str] = (),
                  max_rows: int | None = None, reclaim: Sequence[str] = ()) -> Timeline:
    """Rows with ``_prev``: the row before on the same key (and lost segment)."""
    rows = roles(df, levels, key, role, cycle, name, untraced, reclaim)
    keys = ["key"]
    if lost is not None:
        rows = mark_lost(rows, lost, lost_by)
        keys.append("_segment")
    tl = timeline(rows, keys, max_rows=max_rows)
    return tl.scan(_prev=prev(name, "seq", "_time", "_cpu", "_tid", "_level", "_starts", *carry))


def pair_events(df: DataFrame, levels: Sequence[Sequence[str]], key: str | Column | Mapping = "_tid",
                role: str | Column | Mapping | None = None, cycle: bool = False, name: str = "event",
                untraced: Sequence[str] = (), lost: DataFrame | None = None, lost_by: str | None = None,
                carry: Sequence[str] = (), max_rows: int | None = None,
                reclaim: Sequence[str] = ()) -> DataFrame:
    """Pairs of adjacent levels; ``carry`` payload columns come back as ``start_<c>`` and ``end_<c>``."""
    tl = pair_timeline(df, levels, key, role, cycle, name, untraced, lost, lost_by, carry, max_rows, reclaim)
    p = F.col("_prev")
    adjacent = p["_level"] + 1 == F.col("_level")
    if cycle:
        adjacent = (p["_level"] + 1) % len(levels) == F.col("_level")
    return tl.rows().where(F.col("_ends") & p["_starts"] & (p["_time"] < F.col("_time")) & adjacent).select(
        "key",
        p[name].alias("start"), F.col(name).alias("end"),
        p["seq"].alias("start_id"), F.col("seq").alias("end_id"),
        p["_time"].alias("start_time"), F.col("_time").alias("end_time"),
        (F.col("_time") - p["_time"]).alias("latency"),
        p["_cpu"].alias("start_cpu"), F.col("_cpu").alias("end_cpu"),
        p["_tid"].alias("start_tid"), F.col("_tid").alias("end_tid"),
        *[p[c].alias(f"start_{c}") for c in carry], *[F.col(c).alias(f"end_{c}") for c in carry],
    )


def unpaired(df: DataFrame, levels, key="_tid", role=None, cycle=False, name="event", untraced=(),
             lost: DataFrame | None = None, lost_by: str | None = None, report_orphans: bool = False,
             max_rows: int | None = None, reclaim: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Starts still open at the end of the data (or of a lost segment): at most one per key.

    ``carry``: payload columns to return (not with orphans). ``report_orphans`` adds overwritten starts and ends without a start, with a ``reason`` column.
    """
    if not report_orphans:
        rows = roles(df, levels, key, role, cycle, name, untraced, reclaim)
        keys = ["key"]
        if lost is not None:
            rows = mark_lost(rows, lost, lost_by)
            keys.append("_segment")
        newest = F.max_by(F.struct(name, "seq", "_time", "_cpu", "_tid", "_starts", *carry), F.struct(*ORDER))
        return (rows.groupBy(*keys).agg(newest.alias("r")).where("r._starts")
                .select("key", f"r.{name}", "r.seq", "r._time", "r._cpu", "r._tid", *[f"r.{c}" for c in carry]))
    tl = pair_timeline(df, levels, key, role, cycle, name, untraced, lost, lost_by, (), max_rows, reclaim)
    # The row after a start decides its fate; attach it by scanning for each row's predecessor.
    p = F.col("_prev")
    hop = (p["_level"] + 1) % len(levels) if cycle else p["_level"] + 1
    paired = F.coalesce(F.col("_ends") & p["_starts"] & (p["_time"] < F.col("_time")) & (hop == F.col("_level")),
                        F.lit(False))
    rows = tl.rows().withColumn("_paired", paired)
    orphan_end = rows.where((F.col("_level") != RECLAIMED) & F.col("_ends") & ~F.col("_starts") & ~F.col("_paired")).select(
        "key", name, "seq", "_time", "_cpu", "_tid", F.lit("end").alias("reason"))
    lost_start = rows.where(p["_starts"] & ~F.col("_paired")).select(
        "key", p[name].alias(name), p["seq"].alias("seq"), p["_time"].alias("_time"), p["_cpu"].alias("_cpu"),
        p["_tid"].alias("_tid"), F.lit("overwritten").alias("reason"))
    still_open = unpaired(df, levels, key, role, cycle, name, untraced, lost, lost_by, reclaim=reclaim).withColumn(
        "reason", F.lit("open"))
    return still_open.unionByName(orphan_end).unionByName(lost_start)


def open_starts(df: DataFrame, levels, at: int, older_than: int, **options) -> DataFrame:
    """Starts open at time ``at`` for longer than ``older_than``: their end may have been lost."""
    rows = unpaired(df.where(F.col("_time") <= at), levels, **options)
    age = F.lit(at) - F.col("_time")
    return rows.withColumn("age", age).where(age > older_than)


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("start", "end").agg(F.count("*").alias("paired"))


def outliers(pairs: DataFrame, than: int | None = None, lower: int | None = None) -> DataFrame:
    """Pairs slower than ``than`` or faster than ``lower``."""
    cond = F.lit(False)
    if than is not None:
        cond = cond | (F.col("latency") > than)
    if lower is not None:
        cond = cond | (F.col("latency") < lower)
    return pairs.where(cond)


def epochs(df: DataFrame, trigger: str | Column, max_rows: int | None = None) -> DataFrame:
    """``epoch``: number of trigger events seen up to and including the row, in global time order.

    Triggers are counted per row only when there are many; up to LITERAL_RANGES of them travel as a sorted array,
    which needs no global order of the events.
    """
    fires = as_column(trigger)
    marks = df.where(fires).select(*ORDER).orderBy(*ORDER).limit(LITERAL_RANGES + 1).collect()
    if len(marks) <= LITERAL_RANGES:
        if not marks:
            return df.withColumn("epoch", F.lit(0).cast("bigint"))
        array = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for v, c in zip(m, ORDER)]) for m in marks])
        here = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ORDER])
        return df.withColumn("epoch", position(array, here, len(marks)).cast("bigint"))
    flagged = df.withColumn("__fires", F.when(fires, 1).otherwise(0))
    return timeline(flagged, [], max_rows=max_rows).scan(epoch=run_sum("__fires")).rows().drop("__fires")


def rundelay(switches: DataFrame, wakeups: DataFrame, preempt_state: int = 0, names: Column | None = None,
             max_rows: int | None = None) -> DataFrame:
    """Time from becoming runnable (wakeup, wakeup_new, preempted switch-out) to switch-in, per task.

    switches: ``prev_pid, prev_state, next_pid``; wakeups: ``event`` in sched_wakeup / sched_wakeup_new and ``pid``.
    """
    # A switch row stands on both sides: its previous task may become runnable, its next task gets the CPU.
    sides = F.array(
        F.struct(F.lit("preempted").alias("event"), F.col("prev_pid").alias("pid"),
                 ((F.col("prev_state") == preempt_state) & (F.col("prev_pid") > 0)).alias("use")),
        F.struct(F.lit("switch_in").alias("event"), F.col("next_pid").alias("pid"), F.lit(True).alias("use")),
    )
    from_switch = (switches.withColumn("s", F.explode(sides)).where("s.use")
                   .select("s.event", "s.pid", "_time", "seq", "_cpu", "_tid"))
    from_wakeup = wakeups.select("event", "pid", "_time", "seq", "_cpu", "_tid")
    both = from_wakeup.unionByName(from_switch)
    if names is not None:
        both = both.where(names)
    return pair_events(both, [["sched_wakeup", "sched_wakeup_new", "preempted"], ["switch_in"]], key="pid",
                       max_rows=max_rows)


def drop_unneeded_wakeups(df: DataFrame, switch: str, wakeup: str, next_pid: str = "next_pid", pid: str = "pid",
                          target_cpu: str = "target_cpu", max_rows: int | None = None) -> DataFrame:
    """Drop wakeups by the task itself, and of the task that already runs on the target CPU."""
    is_switch, is_wakeup = F.col("event") == switch, F.col("event") == wakeup
    rows = df.where(is_switch | is_wakeup).withColumns({
        "_on": F.when(is_switch, F.col("_cpu")).otherwise(F.col(target_cpu)),
        "_runs": F.when(is_switch, F.col(next_pid)),
    })
    seen = timeline(rows, "_on", max_rows=max_rows).scan(_running=last("_runs")).rows()
    unneeded = is_wakeup & ((F.col("_tid") == F.col(pid))
                            | F.coalesce(F.col("_running") == F.col(pid), F.lit(False)))
    return seen.where(~unneeded).drop("_on", "_runs", "_running")


def track_cpu(df: DataFrame, moves: Mapping[str, tuple[str, str]], max_rows: int | None = None) -> DataFrame:
    """``on_cpu``: the CPU a task was last sent to; ``moves`` maps event -> (pid expression, cpu expression)."""
    pid = per_event({e: p for e, (p, _) in moves.items()}, default="_tid")
    cpu = per_event({e: c for e, (_, c) in moves.items()})
    rows = df.withColumns({"_task": pid, "_to": cpu})
    return timeline(rows, "_task", max_rows=max_rows).scan(on_cpu=last("_to")).rows().drop("_to")
