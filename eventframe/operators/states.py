"""Per-key state machines: task states, time on CPU, migrations, IO stages, exits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import LATENCY_QUANTILES, distribution, widen
from ..functions.text import in_cpulist, int_div
from ..schema import ORDER
from .pairs import mark_lost
from .rangejoin import overlap_join
from .stats import simple_stats
from .timeline import Timeline, last, prev, timeline

# States a switch-out can leave a task in, and the one that ends it.
SLEEPING = ("S", "D", "T", "t", "I")
DEAD = "X"


def task_moves(switches: DataFrame, wakeups: DataFrame) -> DataFrame:
    """Rows (task, kind, state): out / in from switches, wake / new from wakeups.

    switches: ``prev_pid, prev_state`` ('R' when preempted), ``next_pid``; wakeups: ``event, pid``.
    """
    sides = F.array(
        F.struct(F.col("prev_pid").alias("task"), F.lit("out").alias("kind"), F.col("prev_state").alias("state")),
        F.struct(F.col("next_pid").alias("task"), F.lit("in").alias("kind"), F.lit(None).cast("string").alias("state")))
    a = switches.withColumn("m", F.explode(sides)).select("m.*", "_time", "seq").where("task > 0")
    kind = F.when(F.col("event") == "sched_wakeup_new", "new").otherwise("wake")
    b = wakeups.select(F.col("pid").alias("task"), kind.alias("kind"), F.lit(None).cast("string").alias("state"),
                       "_time", "seq")
    return a.unionByName(b)


def effective_moves(moves: DataFrame, only: Sequence[str] | None = None, lost: DataFrame | None = None,
                    max_rows: int | None = None) -> Timeline:
    """Moves that change a task's state, each with the one ``_before`` it: wakeups of runnable tasks are dropped."""
    sleeping = F.col("kind").eqNullSafe("out") & F.coalesce(F.col("state").isin(*(only or SLEEPING)), F.lit(False))
    if only:
        moves = moves.where(sleeping | (F.col("kind") == "wake"))
    moves = moves.withColumns({
        "_sleeps": sleeping, "_dies": F.coalesce(F.col("state") == DEAD, F.lit(False))})
    keys = ["task"]
    if lost is not None:
        moves = mark_lost(moves, lost)
        keys.append("_segment")
    seen = ("kind", "state", "_time", "seq", "_sleeps", "_dies")
    tl = timeline(moves, keys, max_rows=max_rows).scan(_before=prev(*seen))
    if only:
        return tl
    p = F.col("_before")
    idle = F.coalesce((F.col("kind") == "wake") & ~p["_dies"] & ~p["_sleeps"], F.lit(False))
    return tl.map(lambda f: f.where(~idle).drop("_before")).scan(_before=prev(*seen))


def task_states(moves: DataFrame, only: Sequence[str] | None = None, tasks: Column | None = None,
                lost: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Time spent per state: task, state, from_time, to_time, from_id, to_id, duration.

    R until a switch-out, RD until a switch-in, a sleeping state until a wakeup. A wakeup of a task that is already
    runnable changes nothing; wakeup_new starts over. ``only=("S", "D")`` needs just the matching switch-outs and
    plain wakeups. ``tasks`` filters by a predicate on ``task``.
    """
    if tasks is not None:
        moves = moves.where(tasks)
    return spent(effective_moves(moves, only, lost, max_rows), sleep_only=bool(only))


def spent(moves: Timeline, sleep_only: bool = False) -> DataFrame:
    """The state that ends with each effective move, and for how long it lasted."""
    p = F.col("_before")
    known = p.isNotNull() & ~p["_dies"]
    runnable = ~p["_sleeps"]
    state = F.when(F.col("kind").isin("wake", "new"), F.when(p["_sleeps"], p["state"]))
    if not sleep_only:
        state = (state.when((F.col("kind") == "out") & runnable, F.lit("R"))
                 .when((F.col("kind") == "in") & runnable, F.lit("RD")))
    out = moves.rows().where(known & (p["_time"] < F.col("_time"))).withColumn("_spent", state)
    return out.where("_spent IS NOT NULL").select(
        "task", F.col("_spent").alias("state"), p["_time"].alias("from_time"), F.col("_time").alias("to_time"),
        p["seq"].alias("from_id"), F.col("seq").alias("to_id"), (F.col("_time") - p["_time"]).alias("duration"))


def state_stats(durations: DataFrame, by: Sequence[str] = (), than: int | None = None,
                exact: bool = True, wide: bool | None = False) -> DataFrame:
    return distribution(durations, ["state", *by], "duration", LATENCY_QUANTILES, than, exact, wide)


def state_outliers(durations: DataFrame, than: int) -> DataFrame:
    """Waits and run delays above the threshold (running time is never an offence)."""
    return durations.where((F.col("duration") > than) & (F.col("state") != "R"))


def oncpu_slices(switches: DataFrame, prio: str | None = None, max_rows: int | None = None) -> DataFrame:
    """cpu, tid, start, runtime of each stretch: the previous switch on the CPU brought in the task that leaves now."""
    tl = timeline(switches, "_cpu", max_rows=max_rows).scan(_on=prev("next_pid", "_time"))
    out = tl.rows().where((F.col("_on.next_pid") == F.col("prev_pid")) & (F.col("prev_pid") != 0))
    if prio is not None:
        out = out.where(in_cpulist("prev_prio", prio))
    names = ["prev_comm"] if "prev_comm" in switches.columns else []
    return out.select(F.col("_cpu").alias("cpu"), F.col("prev_pid").alias("tid"),
                      F.col("_on._time").alias("start"), F.col("_time").alias("end"),
                      (F.col("_time") - F.col("_on._time")).alias("runtime"), *[F.col(c).alias("name") for c in names])


def oncpu_by_cpu(switches: DataFrame, prio: str | None = None, by_name: bool = False,
                 max_rows: int | None = None) -> DataFrame:
    """cpu, tid (or name): total runtime, number of stretches, longest."""
    slices = oncpu_slices(switches, prio, max_rows)
    return slices.groupBy("cpu", "name" if by_name else "tid").agg(
        F.sum("runtime").alias("runtime"), F.count("*").alias("switches"), F.max("runtime").alias("max"))


def runtime_by_tid_cpu(runtimes: DataFrame) -> DataFrame:
    """Runtime per (tid, cpu) from runtime events recorded by the task itself."""
    return runtimes.where("_tid = pid").groupBy(F.col("_tid").alias("tid"), F.col("_cpu").alias("cpu")).agg(
        F.sum("runtime").alias("runtime"), F.count("*").alias("n"), F.max("runtime").alias("max"))


def oncpu_by_tid(runtimes: DataFrame) -> DataFrame:
    """tid, total runtime, and ``cpu:runtime`` of every CPU it ran on (bounded by the number of CPUs)."""
    per_cpu = runtime_by_tid_cpu(runtimes)
    items = F.sort_array(F.collect_list(F.struct("cpu", "runtime")))
    text = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["cpu"], x["runtime"])), " ")
    return per_cpu.groupBy("tid").agg(F.sum("runtime").alias("runtime"), text.alias("cpus"))


def corun(per_cpu: DataFrame, thread_siblings: DataFrame, cpu_siblings: DataFrame) -> DataFrame:
    """Upper bound of time a thread ran beside its sibling: sum of min(own, sibling's) over sibling CPU pairs.

    per_cpu: tid, cpu, runtime; thread_siblings: tid, sib_tid; cpu_siblings: cpu, sib_cpu.
    """
    own = per_cpu.join(thread_siblings, "tid").join(cpu_siblings, "cpu")
    other = per_cpu.select(F.col("tid").alias("sib_tid"), F.col("cpu").alias("sib_cpu"),
                           F.col("runtime").alias("_sib"))
    return own.join(other, ["sib_tid", "sib_cpu"], "left").groupBy("tid").agg(
        F.sum("runtime").alias("runtime"),
        F.coalesce(F.sum(F.when(F.col("_sib").isNotNull(), F.least("runtime", "_sib"))), F.lit(0)).alias("co"),
    ).withColumn("co_pct", int_div(F.col("co") * 100, "runtime"))


def with_topology(moves: DataFrame, topology: DataFrame) -> DataFrame:
    """Add ``same_l2`` and ``same_llc`` to moves (orig_cpu, dest_cpu); topology: cpu, l2, llc."""
    def end(prefix):
        return topology.select(F.col("cpu").alias(f"{prefix}_cpu"), F.col("l2").alias(f"_{prefix}_l2"),
                               F.col("llc").alias(f"_{prefix}_llc"))
    out = moves.join(end("orig"), "orig_cpu").join(end("dest"), "dest_cpu")
    return out.withColumns({
        "same_l2": (F.col("_orig_l2") == F.col("_dest_l2")).cast("int"),
        "same_llc": (F.col("_orig_llc") == F.col("_dest_llc")).cast("int"),
    }).drop("_orig_l2", "_orig_llc", "_dest_l2", "_dest_llc")


def migrate_locality(moves: DataFrame, topology: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total, same_llc and same_l2 with integer percentages. Counted per CPU pair before the topology join."""
    counted = moves.groupBy(*by, "orig_cpu", "dest_cpu").agg(F.count("*").alias("n"))
    placed = with_topology(counted, topology)
    n = F.col("n")
    return placed.groupBy(*by).agg(
        F.sum("n").alias("total"), F.sum(n * F.col("same_llc")).alias("same_llc"),
        F.sum(n * F.col("same_l2")).alias("same_l2"),
    ).withColumns({"llc_pct": int_div(F.col("same_llc") * 100, "total"),
                   "l2_pct": int_div(F.col("same_l2") * 100, "total")})


def _io_steps(df: DataFrame, stages: Sequence[str], by: Sequence[str], stage: str, max_rows: int | None) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage)).cast("int")
    rows = df.withColumn("_rank", rank).where("_rank > 0")
    tl = timeline(rows, by, max_rows=max_rows).scan(_was=prev("_rank", "_time"))
    # A completed request is forgotten; whatever comes next on the sector begins a new one.
    return tl.rows().where(F.col("_was._rank") != len(stages)).withColumn("delay", F.col("_time") - F.col("_was._time"))


def _io_merged_steps(df: DataFrame, stages: Sequence[str], by: Sequence[str], stage: str,
                     max_rows: int | None) -> DataFrame:
    """As :func:`_io_steps` for requests whose sector ranges change: they are the same while the ranges overlap.

    Ranges are spread over the largest blocks that all starts and lengths are multiples of, so work grows with the
    sectors, not with pairs of requests. A request passes on to the first later event on any of its blocks; of several
    that meet in one event (a merge), the latest counts as the previous stage.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage)).cast("int")
    rows = df.withColumn("_rank", rank).where("_rank > 0 AND nr_sector > 0")
    bits = rows.agg(F.bit_or(F.expr("sector | nr_sector"))).first()[0] or 1
    block = bits & -bits
    spread = rows.select(*by, stage, *ORDER, "_rank", F.explode(F.expr(
        f"sequence(sector div {block}, (sector + nr_sector) div {block} - 1)")).alias("_block"))
    tl = timeline(spread, [*by, "_block"], max_rows=max_rows).scan(_was=prev(*ORDER, "_rank"))
    met = tl.rows().where("_was IS NOT NULL")
    now = F.struct(*ORDER, F.col(stage).alias("stage"), F.col("_rank").alias("rank"))
    nearest = met.groupBy(*by, "_was").agg(F.min(now).alias("_now")).where(F.col("_was._rank") != len(stages))
    latest = nearest.groupBy(*by, "_now").agg(F.max("_was").alias("_was"))
    return latest.select(F.col("_now.stage").alias(stage), F.col("_now.rank").alias("_rank"), "_was",
                         (F.col("_now._time") - F.col("_was._time")).alias("delay"))


def io_stages(df: DataFrame, stages: Sequence[str], by: Sequence[str] = ("dev", "sector"), stage: str = "event",
              than: int | None = None, merged: bool = False, max_rows: int | None = None) -> DataFrame:
    """Per stage: reqs, total, min, avg, max of the time since the request's previous stage on the same sector.

    ``merged=True`` follows requests by overlapping ranges (columns sector, nr_sector; ``by`` without the sector).
    Flush requests (sector -1) should be filtered out before.
    """
    steps = (_io_merged_steps if merged else _io_steps)(df, stages, by, stage, max_rows)
    return simple_stats(steps, [stage], "delay", than, "reqs").withColumnRenamed(stage, "stage")


def io_flags(df: DataFrame, stages: Sequence[str], by: Sequence[str] = ("dev", "sector"), stage: str = "event",
             merged: bool = False, max_rows: int | None = None) -> DataFrame:
    """Counts of irregular steps: EXIST (a new request over a live one), BYPASS_INSERT, LOST."""
    steps = (_io_merged_steps if merged else _io_steps)(df, stages, by, stage, max_rows)
    flag = (F.when(F.col("_rank") == 1, "EXIST")
            .when(F.col("_was._rank") != F.col("_rank") - 1,
                  F.when(F.col("_rank") == 3, "BYPASS_INSERT").otherwise("LOST")))
    return steps.withColumn("flag", flag).where("flag IS NOT NULL").groupBy(F.col(stage).alias("stage"), "flag").agg(
        F.count("*").alias("n"))


def exit_spans(exits: DataFrame, entries: DataFrame, instance: str = "_cpu",
               max_rows: int | None = None) -> DataFrame:
    """Exits with the first later entry of the same thread before the instance's next exit.

    exits: isa, reason, guest_ip + canonical columns. Output: exit columns, entry_id, latency.
    """
    a = exits.select(F.col(instance).alias("inst"), "_tid", "_time", "seq", "isa", "reason", "guest_ip",
                     F.lit(1).alias("_exit"))
    b = entries.select(F.col(instance).alias("inst"), "_tid", "_time", "seq", F.lit(0).alias("_exit"))
    info = F.struct("_tid", "_time", "seq", "isa", "reason", "guest_ip")
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_info", F.when(F.col("_exit") == 1, info))
    seen = timeline(rows, "inst", max_rows=max_rows).scan(_open=last("_info")).rows()
    o = F.col("_open")
    fits = seen.where((F.col("_exit") == 0) & (o["_tid"] == F.col("_tid")) & (o["_time"] < F.col("_time")))
    first = fits.groupBy("inst", o["seq"].alias("exit_id")).agg(
        F.min_by(F.struct("seq", "_time", "_open"), F.struct(*ORDER)).alias("e"))
    return first.select(
        "inst", "exit_id", F.col("e.seq").alias("entry_id"), F.col("e._open._tid").alias("tid"),
        F.col("e._open.isa").alias("isa"), F.col("e._open.reason").alias("reason"),
        F.col("e._open.guest_ip").alias("guest_ip"), F.col("e._open._time").alias("start_time"),
        F.col("e._time").alias("end_time"), (F.col("e._time") - F.col("e._open._time")).alias("latency"))


def exit_stats(spans: DataFrame, kernel_start: int, by: Sequence[str] = (), than: int | None = None,
               hlt: Mapping[str, int] | None = None, wide: bool | None = False) -> DataFrame:
    """calls, total, min, avg, p99, max and % of time in the guest kernel per (isa, reason).

    ``than`` counts slow exits other than the halt reason of each isa. ``wide``: as in ``distribution``.
    """
    low = F.lit(-(1 << 63))
    in_kernel = F.col("guest_ip").bitwiseXOR(low) >= F.lit(kernel_start).bitwiseXOR(low)   # addresses are unsigned
    sums = {"_gsys": widen(F.when(in_kernel, F.col("latency")).otherwise(0), wide is not False)}
    if than is not None:
        slow = F.col("latency") > than
        for isa, reason in (hlt or {}).items():
            slow = slow & ~((F.col("isa") == isa) & (F.col("reason") == reason))
        sums["than"] = slow.cast("bigint")
    out = distribution(spans, ["isa", "reason", *by], "latency", {"p99": "0.99"}, wide=wide, sums=sums)
    return out.withColumns({
        "avg": int_div("total", "calls"),
        "gsys_pct": F.round(F.col("_gsys") * 100.0 / F.col("total"), 2)}).drop("_gsys")


def span_breakdown(spans: DataFrame, slices: DataFrame) -> DataFrame:
    """Split each span's latency into wait, run delay and own time; count switches inside it.

    spans: span_id, task, start_time, end_time; slices: slice_task, state, slice_start, slice_end (task states).
    """
    hits = overlap_join(spans, slices, ("start_time", "end_time"), ("slice_start", "slice_end"),
                        [("task", "slice_task")])
    part = F.least("end_time", "slice_end") - F.greatest("start_time", "slice_start")
    waits = F.col("state").isin(*SLEEPING)
    inside = hits.groupBy("span_id").agg(
        F.sum(F.when(waits, part).otherwise(0)).alias("wait"),
        F.sum(F.when(F.col("state") == "RD", part).otherwise(0)).alias("rundelay"),
        F.count_if((F.col("state") == "RD") & (F.col("slice_end") <= F.col("end_time"))).alias("switches"))
    out = spans.join(inside, "span_id", "left").withColumn("latency", F.col("end_time") - F.col("start_time"))
    out = out.na.fill(0, ["wait", "rundelay", "switches"])
    return out.withColumn("own", F.col("latency") - F.col("wait") - F.col("rundelay")).select(
        "span_id", "task", "latency", "wait", "rundelay", "own", "switches")
