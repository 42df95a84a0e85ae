"""Point-in-span and span-overlap joins without nested loops.

Each span lives at the level given by the number of hex digits of its length, where it covers at most 17 buckets of
16^(digits-1) units. A point looks up its one bucket on every level that occurs (at most 16). The join is then an
equi-join on (level, bucket, by...) with the exact condition as residual; every match is found exactly once and AQE
can split heavy buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import all_of, as_column


BROADCAST_ROWS = 250_000    # of two tables of spans with more rows neither is broadcast, whatever the sizes of their files


def _level(start: Column, end: Column) -> Column:
    return F.length(F.hex(end - start))


def _levelled(spans: DataFrame, start: str, end: str, flat: bool) -> DataFrame:
    valid = spans.where(F.col(end) >= F.col(start))
    if flat:
        return valid.withColumn("__level", F.expr(f"(length(bin({end} - {start})) + 1) div 2").cast("int"))
    return valid.withColumn("__level", _level(F.col(start), F.col(end)))


def _shift(level, flat: bool):
    """Bits of a bucket on a level (a number or a column)."""
    if not flat:
        return 4 * (level - 1)
    return F.least(2 * level, F.lit(62)) if isinstance(level, Column) else min(2 * level, 62)


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str,
               by: Sequence[tuple[str, str]] = (), extra: Column | None = None,
               how: str = "inner", flat: bool = False, levels: Sequence[int] | None = None, merge: bool = False) -> DataFrame:
    """Rows (point, span) with ``start <= at <= end`` and equal ``by`` columns (point name, span name).

    Column names of the two sides must differ. ``how``: inner, or left_semi / left_anti on the points. ``flat``: levels by
    digits of base 4 and buckets no shorter than their spans, so that a span has two buckets at most (four beyond 2^62) and a point up to 32
    probes: for tables that both are large. ``levels``: those that occur, when known. ``merge``: neither side is broadcast.
    """
    valid = _levelled(spans, start, end, flat)
    if levels is None:
        levels = sorted(r[0] for r in valid.select("__level").distinct().collect())   # at most 16 values, 32 if flat
    shift = _shift(F.col("__level"), flat)
    first = F.call_function("shiftright", F.col(start), shift)
    final = F.call_function("shiftright", F.col(end), shift)
    placed = valid.withColumn("__bucket", F.explode(F.sequence(first, final)))
    if not levels:
        placed = placed.where(F.lit(False))
    if merge:
        placed = placed.hint("merge")
    cells = F.array(*[F.struct(F.lit(v).alias("l"), F.shiftright(F.col(at), _shift(v, flat)).alias("b"))
                      for v in levels or [1]])
    condition = [
        F.col("__pl") == F.col("__level"),
        F.col("__pb") == F.col("__bucket"),
        F.col(at).between(F.col(start), F.col(end)),
        *[F.col(p) == F.col(s) for p, s in by],
    ]
    if extra is not None:
        condition.append(extra)
    if how == "inner":
        probes = (points.withColumn("__cell", F.explode(cells))
                  .withColumns({"__pl": F.col("__cell.l"), "__pb": F.col("__cell.b")}).drop("__cell"))
        joined = probes.join(placed, all_of(condition))
        return joined.drop("__pl", "__pb", "__level", "__bucket")
    # Semi and anti: one level after the other keeps every point a single row.
    out = points
    matched = None
    for v in levels:
        here = placed.where(F.col("__level") == v)
        cond = all_of([F.shiftright(F.col(at), _shift(v, flat)) == F.col("__bucket"), *condition[2:]])
        if how == "left_anti":
            out = out.join(here, cond, "left_anti")
        else:
            hit = out.join(here, cond, "left_semi")
            matched = hit if matched is None else matched.unionByName(hit)
            out = out.join(here, cond, "left_anti")
    if how == "left_anti":
        return out
    return matched if matched is not None else points.where(F.lit(False))


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str],
                 by: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows (a, b) whose half-open spans overlap: ``a.start < b.end and b.start < a.end``.

    Two spans overlap exactly if one starts inside the other, so this is the union of two point-in-span joins:
    b starts at or after a, or a starts strictly after b. The job that finds the levels also counts the spans: when both
    tables are large, neither is broadcast.
    """
    (a0, a1), (b0, b1) = a_span, b_span
    exact = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    swapped = [(y, x) for x, y in by]
    sizes = [dict(_levelled(df, *span, True).groupBy("__level").count().collect()) for df, span in ((a, a_span), (b, b_span))]   # 32 rows at most
    merge = min(sum(x.values()) for x in sizes) > BROADCAST_ROWS
    in_a, in_b = (sorted(x) for x in sizes)
    later_b = range_join(b, a, b0, a0, a1, swapped, exact, flat=True, levels=in_a, merge=merge)
    later_a = range_join(a, b, a0, b0, b1, by, exact & (F.col(a0) > F.col(b0)), flat=True, levels=in_b, merge=merge)
    columns = [*a.columns, *b.columns]
    return later_b.select(*columns).unionByName(later_a.select(*columns))
