"""Resources that were acquired and not released; allocation profiles; live objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ORDER, as_column
from .pairs import mark_lost, pair_events, unpaired
from .timeline import prev, run_max, run_sum, timeline


def leaks(allocs: DataFrame, frees: DataFrame, ptr: str = "ptr", carry: Sequence[str] = ("size", "stack"),
          older_than: int | None = None, now: int | None = None, lost: DataFrame | None = None) -> DataFrame:
    """Allocations that are the last action on their pointer.

    One aggregation by pointer with map-side combine, no sort. ``older_than`` keeps allocations older than that at
    ``now``; with ``lost`` ranges each segment between them is judged on its own.
    """
    cols = [ptr, *ORDER, *carry]
    a = allocs.select(*cols, F.lit(True).alias("_alloc"))
    b = frees.select(ptr, *ORDER, F.lit(False).alias("_alloc"))
    rows = a.unionByName(b, allowMissingColumns=True)
    keys = [ptr]
    if lost is not None:
        rows = mark_lost(rows, lost)
        keys.append("_segment")
    newest = F.max_by(F.struct("_alloc", *ORDER, *carry), F.struct(*ORDER)).alias("r")
    out = rows.groupBy(*keys).agg(newest).where("r._alloc").select(
        ptr, *[F.col(f"r.{c}").alias(c) for c in (*ORDER, *carry)],
        *([F.col("_segment").alias("segment")] if lost is not None else []))
    if older_than is not None:
        out = out.where(F.lit(now) - F.col("_time") > older_than)
    return out


def leak_report(leaked: DataFrame, by: Sequence[str] = ("stack",), size: str = "size",
                sort: bool = False) -> DataFrame:
    """Bytes and objects per group; with ``by=("stack", "name")`` also the stack's totals, one row per name."""
    out = leaked.groupBy(*by).agg(F.sum(size).alias("bytes"), F.count("*").alias("objects"))
    if len(by) > 1:
        head = by[0]
        totals = out.groupBy(head).agg(F.sum("bytes").alias("group_bytes"), F.sum("objects").alias("group_objects"))
        out = out.join(totals, head)
        return out.orderBy(F.desc("group_bytes"), head, F.desc("bytes"), F.desc("objects"), *by[1:]) if sort else out
    return out.orderBy(F.desc("bytes"), *by) if sort else out


def leak_totals(allocs: DataFrame, frees: DataFrame, ptr: str = "ptr", size: str = "size") -> DataFrame:
    """Numbers of allocations and frees, and what is still live. One pass: every pointer is reduced to its last action."""
    a = allocs.select(ptr, *ORDER, F.col(size).alias("_size"), F.lit(1).alias("_alloc"))
    b = frees.select(ptr, *ORDER, F.lit(0).alias("_alloc"))
    per_ptr = a.unionByName(b, allowMissingColumns=True).groupBy(ptr).agg(
        F.sum("_alloc").alias("allocs"), F.sum(1 - F.col("_alloc")).alias("frees"),
        F.max_by(F.struct("_alloc", "_size"), F.struct(*ORDER)).alias("r"))
    live = F.col("r._alloc") == 1
    return per_ptr.agg(
        F.sum("allocs").alias("allocs"), F.sum("frees").alias("frees"), F.count_if(live).alias("live"),
        F.coalesce(F.sum(F.when(live, F.col("r._size"))), F.lit(0)).alias("live_bytes"))


def mem_profile(df: DataFrame, alloc: Sequence[str], free: Sequence[str], ptr: str | Column = "ptr",
                size: str | Column = "size", stack: str = "stack", top: int | None = 10, name: str = "event",
                max_rows: int | None = None) -> DataFrame:
    """Bytes and objects by stack and pair of event types: freed allocations by alloc and by free stack, unfreed ones by alloc stack.

    side (alloc / free / unfreed), alloc and free (event types; free is null where nothing was freed), stack, bytes,
    bytes_pct, objects, objects_pct, rank, skipped; the ``top`` stacks by bytes per side and pair of event types, and
    how many more stacks there are.
    """
    rows = df.withColumn("_size", as_column(size))
    levels = [list(alloc), list(free)]
    p = pair_events(rows, levels, ptr, name=name, carry=("_size", stack), max_rows=max_rows)
    # Both stacks of a pair carry the allocation's bytes; explode keeps this one pass over the pairs.
    sides = F.array(F.struct(F.lit("alloc").alias("side"), F.col(f"start_{stack}").alias("stack")),
                    F.struct(F.lit("free").alias("side"), F.col(f"end_{stack}").alias("stack")))
    freed = p.select(F.explode(sides).alias("s"), F.col("start").alias("alloc"), F.col("end").alias("free"), F.col("start__size").alias("_b"))
    open_ = unpaired(rows, levels, ptr, name=name, max_rows=max_rows, carry=("_size", stack)).select(
        F.lit("unfreed").alias("side"), F.col(stack).alias("stack"), F.col(name).alias("alloc"), F.lit(None).cast("string").alias("free"), F.col("_size").alias("_b"))
    section = ["side", "alloc", "free"]
    both = freed.select("s.side", "s.stack", "alloc", "free", "_b").unionByName(open_).groupBy(*section, "stack").agg(
        F.sum("_b").alias("bytes"), F.count("*").alias("objects"))
    total = both.groupBy(*section).agg(F.sum("bytes").alias("_tb"), F.sum("objects").alias("_to"), F.count("*").alias("_ts"))
    total = total.withColumnsRenamed({c: f"_t_{c}" for c in section})
    shown, skipped = both, F.lit(0).cast("bigint")
    if top is not None:
        # Spark keeps only the first `top` rows per section in every map task before this window's shuffle.
        w = Window.partitionBy(*section).orderBy(F.desc("bytes"), "stack")
        shown = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        skipped = F.greatest(F.col("_ts") - top, F.lit(0))
    same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in section]
    return shown.join(total, same).withColumns({
        "bytes_pct": F.round(F.try_divide(F.col("bytes") * 100.0, "_tb"), 1),
        "objects_pct": F.round(F.try_divide(F.col("objects") * 100.0, "_to"), 1),
        "skipped": skipped}).drop("_tb", "_to", "_ts", *[f"_t_{c}" for c in section])


def live_snapshot(df: DataFrame, key: str | Sequence[str], create: Column, delete: Column, flags: str | None = None,
                  max_rows: int | None = None) -> DataFrame:
    """Objects whose last create/delete is a create, with creation time and the OR of flags set since."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.withColumns({"_new": F.when(create, 1).otherwise(0), "_gone": F.when(delete, 1).otherwise(0)})
    rows = rows.withColumns({"_turn": F.col("_new") + F.col("_gone"),
                             "_flags": F.coalesce(F.col(flags).cast("bigint"), F.lit(0)) if flags else F.lit(0)})
    tl = timeline(rows, keys, max_rows=max_rows).scan(_life=run_sum("_turn"))
    lives = tl.rows().groupBy(*keys, "_life").agg(
        F.max("_new").alias("_new"), F.min("_time").alias("created"), F.bit_or("_flags").alias("flags"),
        (F.count("*") - 1).alias("updates"))
    newest = lives.groupBy(*keys).agg(F.max_by(F.struct("_new", "created", "flags", "updates"), "_life").alias("r"))
    return newest.where("r._new = 1").select(*keys, "r.created", "r.flags", "r.updates")


def coalesce_ranges(df: DataFrame, start: str, end: str, by: Sequence[str] = (), gap: int = 1,
                    max_rows: int | None = None) -> DataFrame:
    """Merge ranges that overlap or follow each other within ``gap`` (1 for closed integer ranges).

    Equal ranges are counted first: what remains has one order, so that the three scans see the same one.
    """
    ranges = df.groupBy(*by, start, end).agg(F.count("*").alias("_equal"))
    tl = timeline(ranges, by, order=(start, end), max_rows=max_rows)
    tl = tl.scan(_reach=run_max(end)).scan(_before=prev("_reach"))
    fresh = F.when(F.col(start) <= F.col("_before._reach") + gap, 0).otherwise(1)
    tl = tl.map(lambda f: f.withColumn("_fresh", fresh)).scan(_island=run_sum("_fresh"))
    return tl.rows().groupBy(*by, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.sum("_equal").alias("merged")).drop("_island")
