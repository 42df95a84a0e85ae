"""Exact distribution statistics that hold when one group has most of the rows.

Values are counted first (map-side combined, balanced by value). Ranks are located in coarse value cells, so only the
few cells that contain a wanted rank are ordered; no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import any_of, as_column, join_same
from ..shared import stored

CELL_BITS = 12   # a cell spans at most 1/4096 of its values
# The quantiles every latency report shows.
LATENCY_QUANTILES = {"p50": "0.5", "p95": "0.95", "p99": "0.99"}


def _cell(value: Column) -> Column:
    """Monotone coarse cell of a BIGINT: the sign, the bit length and the leading bits."""
    size = F.when(value < 0, -value).otherwise(value)
    drop = F.greatest(F.length(F.bin(size)) - (CELL_BITS + 1), F.lit(0))
    top = F.call_function("shiftright", size, drop)
    cell = drop.cast("bigint") * (1 << (CELL_BITS + 2)) + top
    return F.when(value < 0, -cell).otherwise(cell)


def distribution(df: DataFrame, by: Sequence[str], value: str | Column,
                 quantiles: Mapping[str, str] = LATENCY_QUANTILES, than: int | None = None,
                 exact: bool = True, wide: bool | None = False,
                 sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Per group: calls, total, min, the quantiles (discrete), max and, with ``than``, the number above it.

    ``exact=False`` uses Spark's mergeable quantile sketch instead: one shuffle, relative rank error 1e-4.
    ``sums``: further columns summed per group in the same pass. ``wide=True`` returns the total as DECIMAL(38,0), for sums beyond 2^63 (292 years in ns);
    ``wide=None`` only where some group's total needs it (see ``fitted``), else as BIGINT.
    """
    if wide is None:
        return fitted(distribution(df, by, value, quantiles, than, exact, True, sums), "total")
    by = list(by)
    more = dict(sums or {})
    values = df.select(*by, as_column(value).cast("bigint").alias("__v"),
                       *[c.alias(n) for n, c in more.items()]).where("__v IS NOT NULL")
    if not exact or not quantiles:
        aggs = _basic(F.count("*"), F.sum(widen("__v", wide)), F.min("__v"), F.max("__v"))
        for name, p in quantiles.items():
            aggs.insert(-1, F.percentile_approx("__v", float(p), 10_000).alias(name))
        if than is not None:
            aggs.append(F.count_if(F.col("__v") > than).alias("than"))
        aggs += [F.sum(n).alias(n) for n in more]
        return values.groupBy(*by).agg(*aggs)

    counts = values.groupBy(*by, "__v").agg(
        F.count("*").alias("__n"), *[F.sum(n).alias(n) for n in more])
    celled = counts.withColumn("__cell", _cell(F.col("__v")))
    above = F.sum(F.when(F.col("__v") > than, F.col("__n")).otherwise(0)) if than is not None else F.lit(0)
    cells = celled.groupBy(*by, "__cell").agg(
        F.sum("__n").alias("__cn"), F.sum(widen("__v", wide) * F.col("__n")).alias("__cs"),
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), above.cast("bigint").alias("__above"),
        *[F.sum(n).alias(n) for n in more],
    )
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    cum = F.sum("__cn").over(whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({
        "__before": cum - F.col("__cn"),
        "__calls": F.sum("__cn").over(whole), "__total": F.sum("__cs").over(whole),
        "__min": F.min("__lo").over(whole), "__max": F.max("__hi").over(whole),
        "__than": F.sum("__above").over(whole), **{f"__s_{n}": F.sum(n).over(whole) for n in more},
    })
    rank = {name: _rank(p, F.col("__calls")) for name, p in quantiles.items()}
    holds = any_of([(F.col("__before") < r) & (r <= F.col("__before") + F.col("__cn")) for r in rank.values()])
    wanted = cells.where(holds).drop("__cn", "__cs", "__lo", "__hi", "__above", *more)
    inside = Window.partitionBy(*by, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = join_same(celled.drop(*more), wanted, [*by, "__cell"]).withColumn(
        "__at", F.col("__before") + F.sum("__n").over(inside))
    picks = [F.min(F.when((F.col("__at") >= r) & (F.col("__before") < r), F.col("__v"))).alias(name)
             for name, r in rank.items()]
    aggs = _basic(*[F.first(c) for c in ("__calls", "__total", "__min", "__max")])
    aggs[-1:-1] = picks
    if than is not None:
        aggs.append(F.first("__than").alias("than"))
    aggs += [F.first(f"__s_{n}").alias(n) for n in more]
    return ranked.groupBy(*by).agg(*aggs)


def widen(value: str | Column, wide: bool) -> Column:
    return as_column(value).cast("decimal(19,0)") if wide else as_column(value)


def fitted(df: DataFrame, total: str) -> DataFrame:
    """The wide column ``total`` as BIGINT if every group's value fits; otherwise it stays DECIMAL(38,0), exact.

    The frame (one row per group) is stored and read once to decide, so this runs the job.
    """
    kept = stored(df, "totals")
    fits = kept.agg(F.bool_and(F.col(total).between(-(1 << 63), (1 << 63) - 1))).first()[0]
    return kept if fits is False else kept.withColumn(total, F.col(total).cast("bigint"))


def _basic(calls: Column, total: Column, low: Column, high: Column) -> list[Column]:
    return [calls.alias("calls"), total.alias("total"), low.alias("min"), high.alias("max")]


def _rank(p: str, n: Column) -> Column:
    """ceil(p * n) in integers, at least 1."""
    num, den = Decimal(p).as_integer_ratio()
    return F.greatest(F.call_function("div", n * num + (den - 1), F.lit(den)), F.lit(1))
