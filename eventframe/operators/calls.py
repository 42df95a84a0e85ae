"""Nested calls: matching entries with returns, callers, depth and open frames.

Returns close the latest open entry of the same function on the same key; returns without one are ignored. Callers
and depth come from running sums, which is exact when calls nest properly (``nesting_errors`` lists returns where they
do not); ``callers_any_nesting`` is exact always.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import LATENCY_QUANTILES, distribution
from ..schema import per_event
from .rangejoin import range_join
from .timeline import CHUNK, Timeline, last, prev, run_min, run_sum, timeline


def _steps(df: DataFrame, functions: Mapping[str, tuple[str, str]], key, name: str) -> DataFrame:
    fn, d = {}, {}
    for f, (entry, ret) in functions.items():
        fn[entry] = fn[ret] = F.lit(f)
        d[entry], d[ret] = F.lit(1), F.lit(-1)
    return df.where(F.col(name).isin(list(fn))).select(
        per_event(key, name).alias("key"), per_event(fn, name).alias("fn"), per_event(d, name).alias("d"),
        "_time", "seq")


def call_rows(df: DataFrame, functions: Mapping[str, tuple[str, str]], key: str | Column | Mapping = "_tid",
              name: str = "event", max_rows: int | None = None) -> Timeline:
    """Entries (d = 1) and matched returns (d = -1) of each key.

    ``again``: open entries of the same function at that point (1 = not recursive); ``level``: depth of the call over
    all functions (1 = root); ``_open``: the matching entry on return rows.
    """
    tl = timeline(_steps(df, functions, key, name), "key", max_rows=max_rows)
    # All windows below partition by a superset of this key, so this is the only shuffle.
    tl = tl.map(lambda f: f.repartition("key", CHUNK) if tl.cut else f.repartition("key"))
    per_fn = tl.rekey("fn").scan(_s=run_sum("d")).scan(_m=run_min("_s"))
    again = F.col("_s") - F.least(F.lit(0), F.col("_m"))
    per_fn = per_fn.map(lambda f: f.withColumn("again", F.when(F.col("d") == 1, again).otherwise(again + 1)))
    matched = per_fn.rekey("again").scan(_open=prev("d", "_time", "seq"))
    rows = matched.frame.where((F.col("d") == 1) | (F.col("_open.d") == 1)).drop("_s", "_m")
    whole = replace(tl, frame=rows).scan(_depth=run_sum("d"))
    level = F.when(F.col("d") == 1, F.col("_depth")).otherwise(F.col("_depth") + 1)
    return whole.map(lambda f: f.withColumn("level", level).drop("_depth"))


def match_calls(calls: Timeline) -> DataFrame:
    """key, fn, level, recursive, entry_id, ret_id, entry_time, ret_time, latency of completed calls."""
    return calls.rows().where("d = -1").select(
        "key", "fn", "level", (F.col("again") > 1).cast("int").alias("recursive"),
        F.col("_open.seq").alias("entry_id"), F.col("seq").alias("ret_id"),
        F.col("_open._time").alias("entry_time"), F.col("_time").alias("ret_time"),
        (F.col("_time") - F.col("_open._time")).alias("latency"))


def callers(calls: Timeline) -> DataFrame:
    """Every entry with its caller: the last earlier entry one level up (``root`` when there is none)."""
    own = F.struct(F.col("level").alias("group"), F.lit(None).cast("string").alias("candidate"), F.lit(1).alias("child"))
    up = F.struct((F.col("level") + 1).alias("group"), F.col("fn").alias("candidate"), F.lit(0).alias("child"))
    entries = calls.map(lambda f: f.where("d = 1").drop("_open")
                        .withColumn("s", F.explode(F.array(own, up))).select("*", "s.*").drop("s"))
    seen = entries.rekey("group").scan(_caller=last("candidate")).rows()
    return seen.where("child = 1").select(
        "key", "fn", "level", (F.col("again") > 1).cast("int").alias("recursive"), "seq", "_time",
        F.when(F.col("level") > 1, F.col("_caller")).otherwise(F.lit("root")).alias("caller"))


def callers_any_nesting(calls: Timeline) -> DataFrame:
    """Every entry with its caller - the latest entry still open - when returns may cross each other.

    Completed calls that enclose the entry are found by a range join, as many rows as the stacks are deep. Calls that
    never return enclose everything after them, but only the latest of those can be the caller: a running value.
    """
    entries = calls.map(lambda f: f.where("d = 1").drop("_open", "level", "again"))
    done = calls.rows().where("d = -1").select(
        F.col("key").alias("_k"), F.col("fn").alias("_f"), F.col("_open._time").alias("_t0"),
        F.col("_open.seq").alias("_s0"), F.col("_time").alias("_t1"), F.col("seq").alias("_s1"))
    returned = done.select(F.col("_k").alias("key"), F.col("_s0").alias("seq"), F.lit(1).alias("_done"))
    marked = entries.map(lambda f: f.join(returned, ["key", "seq"], "left").withColumns({
        "_lasting": F.when(F.col("_done").isNull(), F.struct("_time", "seq", "fn")),
        "_count": F.when(F.col("_done").isNull(), 1).otherwise(0)}))
    # The scans include the row itself, so take them from the row before.
    marked = marked.scan(_upto=last("_lasting"), _held=run_sum("_count")).scan(_was=prev("_upto", "_held")).rows()
    base = marked.select("key", "fn", "seq", "_time", F.col("_was._upto").alias("_stay"),
                         F.coalesce(F.col("_was._held"), F.lit(0)).alias("_stays"))
    here, t0, t1 = F.struct("_time", "seq"), F.struct("_t0", "_s0"), F.struct("_t1", "_s1")
    around = range_join(base.select("key", "fn", "seq", "_time"), done, "_time", "_t0", "_t1", [("key", "_k")],
                        (t0 < here) & (here < t1))
    inner = around.groupBy("key", "seq").agg(
        F.max(F.struct(F.col("_t0").alias("_time"), F.col("_s0").alias("seq"), F.col("_f").alias("fn"))).alias("_in"),
        F.count("*").alias("_deep"))
    out = base.join(inner, ["key", "seq"], "left")
    nearest = F.greatest("_in", "_stay")
    return out.select("key", "fn", "seq", "_time",
                      (F.coalesce(F.col("_deep"), F.lit(0)) + F.col("_stays") + 1).alias("level"),
                      F.coalesce(nearest["fn"], F.lit("root")).alias("caller"))


def call_edges(calls: Timeline) -> DataFrame:
    """caller, callee, calls, depth of the shallowest call (root calls are 0), whether any call was recursive."""
    return callers(calls).groupBy("caller", F.col("fn").alias("callee")).agg(
        F.count("*").alias("calls"), (F.min("level") - 1).alias("depth"), F.max("recursive").alias("recursive"))


def call_delay(calls: Timeline, exact: bool = True, wide: bool | None = False) -> DataFrame:
    """Latency distribution per function with its depth in the call tree and recursion flag; ``wide`` as in ``distribution``."""
    shape = calls.rows().where("d = 1").groupBy("fn").agg(
        (F.min("level") - 1).alias("depth"), F.max((F.col("again") > 1).cast("int")).alias("recursive"))
    return distribution(match_calls(calls), ["fn"], "latency", LATENCY_QUANTILES, exact=exact, wide=wide).join(shape, "fn")


def nesting_errors(calls: Timeline) -> DataFrame:
    """Returns whose function is not the innermost open one: callers around them may be off."""
    top = calls.rekey("level").scan(_top=prev("fn", "d")).rows()
    return top.where((F.col("d") == -1) & ((F.col("_top.fn") != F.col("fn")) | (F.col("_top.d") != 1))).select(
        "key", "fn", "level", "seq", "_time")


def open_frames(df: DataFrame, functions: Mapping[str, tuple[str, str]], samples: Sequence[str],
                key: str | Column | Mapping = "_tid", name: str = "event",
                max_rows: int | None = None) -> DataFrame:
    """Call stack (root first) at each sample event, rebuilt from function entries and returns."""
    calls = call_rows(df, functions, key, name, max_rows)
    marks = df.where(F.col(name).isin(list(samples))).select(
        per_event(key, name).alias("key"), F.lit(0).alias("d"), "_time", "seq")
    moves = calls.rows().drop("_open", "again").unionByName(marks, allowMissingColumns=True)
    tl = timeline(moves, "key", max_rows=max_rows).scan(_depth=run_sum("d"))
    # A sample asks every level from 1 to its depth; an entry answers on its own level.
    levels = F.when(F.col("d") == 0, F.when(F.col("_depth") > 0, F.sequence(F.lit(1), F.col("_depth").cast("int")))) \
        .otherwise(F.array(F.col("level").cast("int")))
    asked = tl.map(lambda f: f.where("d >= 0").withColumn("_at", F.explode(levels)).withColumn(
        "_entered", F.when(F.col("d") == 1, F.col("fn"))))
    found = asked.rekey("_at").scan(_frame=last("_entered")).rows().where("d = 0")
    stacks = found.groupBy("key", F.col("seq").alias("sample_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_frame"))), lambda x: x["_frame"]).alias("stack"))
    base = marks.select("key", F.col("seq").alias("sample_id"))
    return base.join(stacks, ["key", "sample_id"], "left").withColumn(
        "stack", F.coalesce("stack", F.array().cast("array<string>")))
