"""Events around a pair: the detail view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import per_event
from .pairs import outliers
from .rangejoin import overlap_join, range_join
from .timeline import prev, run_sum, timeline

FIRST, LAST = -(1 << 62), 1 << 62   # before and after any time


def _criteria(same: str | Sequence[str] | None) -> list[str]:
    names = [] if same is None else [same] if isinstance(same, str) else list(dict.fromkeys(same))
    unknown = set(names) - {"key", "cpu", "pid", "tid"}
    if unknown:
        raise ValueError(f"same={same!r}")
    return names


def _values(pairs: DataFrame, criterion: str, side: Sequence[int]) -> Column:
    """The different values a pair gives for a criterion."""
    if criterion == "key":
        return F.array("key")
    field = "_pid" if criterion == "pid" else criterion
    names = [f"{'start' if s == 1 else 'end'}_{field}" for s in side]
    if not set(names) <= set(pairs.columns):
        raise ValueError(f"same={criterion!r} needs the columns {', '.join(names)}: make the pairs with carry=('{field}',)")
    return F.array_distinct(F.array(*names))


def context(pairs: DataFrame, df: DataFrame, before: int = 0, after: int = 0, same: str | Sequence[str] | None = None,
            side: Sequence[int] = (1, 2), key: str | Column | Mapping | None = None, name: str = "event",
            than: int | None = None, lower: int | None = None) -> DataFrame:
    """Events in [start - before, end + after] of each pair, optionally on the same key, cpu, pid or tid.

    ``same``: one criterion or several; an event that meets any of them is taken, once. "pid" needs pairs made with
    ``carry=("_pid",)``. ``side``: which end of the pair gives the cpu, pid or tid to compare with (1, 2 or both).
    ``than`` / ``lower``: only pairs slower / faster than these, as in :func:`outliers`. Untraced event types take part
    like any other. Output: pair_id (the end's id), start_id, part, offset from the start, event columns.
    """
    if than is not None or lower is not None:
        pairs = outliers(pairs, than, lower)
    keep = df.columns
    spans = pairs.select(
        F.col("end_id").alias("pair_id"), "start_id", F.col("start_time").alias("_t1"), F.col("end_time").alias("_t2"),
        (F.col("start_time") - before).alias("_from"), (F.col("end_time") + after).alias("_to"),
        *[_values(pairs, c, side).alias(f"_v_{c}") for c in _criteria(same)])
    if "key" in _criteria(same):
        df = df.withColumn("_ekey", per_event(key, name))
    if not _criteria(same):
        out = range_join(df, spans, "_time", "_from", "_to")
    else:
        # One equi-join per criterion; each leaves out the events that an earlier one has taken.
        out, taken = None, None
        for c in _criteria(same):
            column = "_ekey" if c == "key" else f"_{c}"
            rows = spans.withColumn("_v", F.explode(f"_v_{c}"))
            found = range_join(df, rows, "_time", "_from", "_to", [(column, "_v")], taken).drop("_v")
            out = found if out is None else out.unionByName(found)
            other = ~F.coalesce(F.array_contains(F.col(f"_v_{c}"), F.col(column)), F.lit(False))
            taken = other if taken is None else taken & other
    return _placed(out, keep)


def _placed(out: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The result's columns: where an event stands in its pair, and how long after the start."""
    t, s = F.col("_time"), F.col("seq")
    part = (F.when((t < F.col("_t1")) | ((t == F.col("_t1")) & (s < F.col("start_id"))), "before")
            .when(s == F.col("start_id"), "start").when(s == F.col("pair_id"), "end")
            .when((t > F.col("_t2")) | ((t == F.col("_t2")) & (s > F.col("pair_id"))), "after")
            .otherwise("between"))
    return out.select("pair_id", "start_id", part.alias("part"), (t - F.col("_t1")).alias("offset"), *keep)


def residences(df: DataFrame, moves: Mapping[str, tuple[str, str]], name: str = "event", max_rows: int | None = None) -> DataFrame:
    """_task, _on, _a, _b: the CPU a task is on in [_a, _b), as :func:`track_cpu` follows it.

    ``moves`` maps event -> (task expression, cpu expression). Before its first move a task is where it is seen (_on NULL).
    """
    moved = df.where(F.col(name).isin(list(moves))).select(
        "_time", "seq", per_event({e: p for e, (p, _) in moves.items()}, name).alias("_task"),
        per_event({e: c for e, (_, c) in moves.items()}, name).alias("_on")).where("_task IS NOT NULL AND _on IS NOT NULL")
    closed = timeline(moved, "_task", max_rows=max_rows).scan(_p=prev("_on", "_time")).rows().select(
        "_task", F.col("_p._on").alias("_on"), F.coalesce("_p._time", F.lit(FIRST)).alias("_a"), F.col("_time").alias("_b"))
    newest = moved.groupBy("_task").agg(F.max_by(F.struct("_on", "_time"), F.struct("_time", "seq")).alias("r"))
    return closed.unionByName(newest.select("_task", "r._on", F.col("r._time").alias("_a"), F.lit(LAST).alias("_b"))).where("_a < _b")


def context_on_cpu(pairs: DataFrame, df: DataFrame, moves: Mapping[str, tuple[str, str]], before: int = 0, after: int = 0,
                   task: str = "start_tid", name: str = "event", max_rows: int | None = None) -> DataFrame:
    """Events in [start - before, end + after] of each pair on the CPU that its task is on at the event's time.

    The pair's time is cut where the task moves, each piece is joined with the events of that CPU; a task that never moved is on the
    start's CPU. Output as of :func:`context`.
    """
    spans = pairs.select(
        F.col("end_id").alias("pair_id"), "start_id", F.col(task).alias("_who"), F.col("start_cpu").alias("_at"), F.col("start_time").alias("_t1"),
        F.col("end_time").alias("_t2"), (F.col("start_time") - before).alias("_from"), (F.col("end_time") + after + 1).alias("_to"))
    stays = residences(df, moves, name, max_rows)
    pieces = overlap_join(spans, stays, ("_from", "_to"), ("_a", "_b"), [("_who", "_task")]).drop("_task")
    still = spans.join(stays.select(F.col("_task").alias("_who")).distinct(), "_who", "left_anti").withColumns(
        {"_on": F.lit(None).cast(stays.schema["_on"].dataType), "_a": F.lit(FIRST), "_b": F.lit(LAST)})
    cut = pieces.unionByName(still).select(
        "pair_id", "start_id", "_t1", "_t2", F.coalesce("_on", "_at").alias("_v"), F.greatest("_from", "_a").alias("_lo"), (F.least("_to", "_b") - 1).alias("_hi"))
    return _placed(range_join(df, cut, "_time", "_lo", "_hi", [("_cpu", "_v")]), df.columns)


def hide_close(rows: DataFrame, than: int, max_rows: int | None = None) -> DataFrame:
    """Thin out the events between start and end that follow their predecessor by less than ``than``.

    The first event and the last one of a hidden run stay; ``hidden`` is the number dropped just before a kept row.
    A run that reaches the end of the pair is dropped whole and counted on a row of its own (``event`` NULL).
    """
    between = rows.where("part = 'between'")
    tl = timeline(between, "pair_id", max_rows=max_rows).scan(_p=prev("_time"))
    close = F.coalesce(F.col("_time") - F.col("_p._time") < than, F.lit(False)).cast("int")
    tl = tl.map(lambda f: f.withColumn("_close", close))
    # A run: one row far from its predecessor and the close rows after it.
    tl = tl.map(lambda f: f.withColumn("_far", F.lit(1) - F.col("_close"))).scan(_run=run_sum("_far"))
    runs = tl.rows().groupBy("pair_id", "_run").agg(
        F.min_by(F.struct("event", "seq", "_time", "offset"), F.struct("_time", "seq")).alias("head"),
        F.max_by(F.struct("event", "seq", "_time", "offset"), F.struct("_time", "seq")).alias("tail"),
        (F.count("*") - 1).alias("n"))
    final = runs.groupBy("pair_id").agg(F.max("_run").alias("_last"))
    runs = runs.join(final, "pair_id")
    none = F.lit(None)
    head = F.struct(F.col("head.event"), F.col("head.seq"), F.col("head._time"), F.col("head.offset"),
                    F.lit(0).cast("bigint").alias("hidden"))
    tail = F.struct(F.col("tail.event"), F.col("tail.seq"), F.col("tail._time"), F.col("tail.offset"),
                    (F.col("n") - 1).alias("hidden"))
    rest = F.struct(none.cast("string").alias("event"), none.cast("bigint").alias("seq"),
                    none.cast("bigint").alias("_time"), none.cast("bigint").alias("offset"), F.col("n").alias("hidden"))
    items = (F.when(F.col("n") == 0, F.array(head))
             .when(F.col("_run") == F.col("_last"), F.array(head, rest))
             .otherwise(F.array(head, tail)))
    return runs.select("pair_id", F.explode(items).alias("i")).select("pair_id", "i.*")
