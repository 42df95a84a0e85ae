"""Call stacks: symbolizing, counting, folding, flame graph tables.

A stack is an array, outermost frame last for raw address stacks (leaf first) and outermost first for named frames.
Everything after the first count works on distinct stacks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_column
from .enrich import symbolize


def stack_counts(df: DataFrame, stack: str = "stack", value: str | Column | None = None, top: int | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Events (and summed value) per identical stack; ``top`` keeps the first ones by value, then count."""
    aggs = [F.count("*").alias("n")]
    order = [F.desc("n"), stack]
    if value is not None:
        aggs.append(F.sum(as_column(value)).alias("value"))
        order.insert(0, F.desc("value"))
    out = df.groupBy(*by, stack).agg(*aggs)
    return out.orderBy(*order).limit(top) if top is not None else out


def symbolize_stack(df: DataFrame, symbols: DataFrame, stack: str = "stack", unknown: str = "Unknown",
                    max_rows: int | None = None) -> DataFrame:
    """Add ``frames``: array of ``symbol+offset`` in stack order. Each distinct stack is symbolized once."""
    distinct = df.select(stack).distinct()
    single = distinct.select(F.col(stack), F.posexplode(stack).alias("_pos", "_addr"))
    named = symbolize(single, "_addr", symbols, unknown=unknown, max_rows=max_rows)
    label = F.when(F.col("offset").isNull(), F.col("symbol")).otherwise(
        F.concat(F.col("symbol"), F.lit("+0x"), F.lower(F.hex("offset"))))
    whole = named.groupBy(stack).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col("_pos"), label.alias("label")))),   # bounded by stack depth
        lambda x: x["label"]).alias("frames"))
    return df.join(whole, stack, "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<string>")))


def folded(df: DataFrame, frames: str = "frames", root: str | Column | None = None, bucket: int | None = None,
           reverse: bool = False, value: str | Column | None = None) -> DataFrame:
    """``outer;...;leaf`` with its count. Optional outer frames: time bucket start, then process name.

    ``reverse`` if the array is leaf first. Empty stacks are dropped.
    """
    path = F.reverse(F.col(frames)) if reverse else F.col(frames)
    outer = []
    if bucket:
        outer.append(F.expr(f"cast((_time div {bucket}L) * {bucket}L as string)"))
    if root is not None:
        outer.append(as_column(root))
    rows = df.where(F.size(frames) > 0)
    # Group by the array first, join strings on the distinct stacks only.
    counted = rows.groupBy(*[o.alias(f"_o{i}") for i, o in enumerate(outer)], path.alias("_path")).agg(
        (F.count("*") if value is None else F.sum(as_column(value))).alias("count"))
    text = F.concat_ws(";", *[F.col(f"_o{i}") for i in range(len(outer))], F.array_join("_path", ";"))
    return counted.select(text.alias("stack"), "count")


def trim_stack(df: DataFrame, stack: str = "stack", ctx: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Keep one context (kernel / user) of a stack of (ctx, ...) structs, and at most ``max_depth`` frames."""
    out = F.col(stack)
    if ctx is not None:
        out = F.filter(out, lambda f: f["ctx"] == ctx)
    if max_depth is not None:
        out = F.slice(out, 1, max_depth)
    return df.withColumn(stack, out)


def flame_tree(df: DataFrame, frames: str = "frames", reverse: bool = False,
               value: str | Column | None = None) -> DataFrame:
    """Every path prefix with its depth, inclusive and self value; ``reverse`` merges leaf first."""
    path = F.reverse(F.col(frames)) if reverse else F.col(frames)
    counted = df.where(F.size(frames) > 0).groupBy(path.alias("_path")).agg(
        (F.count("*") if value is None else F.sum(as_column(value))).alias("_n"))
    prefixes = counted.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("_path"))))
    own = F.when(F.col("depth") == F.size("_path"), F.col("_n")).otherwise(0)
    return prefixes.groupBy(
        F.array_join(F.slice("_path", F.lit(1), F.col("depth")), ";").alias("path"), "depth",
    ).agg(F.sum("_n").alias("inclusive"), F.sum(own).alias("self"))
