"""As-of and floor lookups against versioned or sorted dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import as_column
from .rangejoin import range_join
from .timeline import last, timeline

SIGN = -(1 << 63)
MOST = (1 << 63) - 1
PAGE_BITS = 16      # address bits of a page, and of the pages of a page
LEVELS = 64 // PAGE_BITS


def asof(df: DataFrame, table: DataFrame, by: Sequence[str], columns: Sequence[str], at: str = "_time",
         table_at: str = "_time", tie: str = "seq", max_rows: int | None = None) -> DataFrame:
    """Add the table's ``columns`` as valid at each row's time (latest table row with the same ``by``, not later)."""
    value = F.struct(*columns)
    if tie not in table.columns:
        table = table.withColumn(tie, F.lit(0).cast("bigint"))
    dim = table.select(*by, F.col(table_at).alias(at), F.lit(0).alias("_side"), value.alias("_value"),
                       F.col(tie).alias("_tie"))
    facts = df.withColumns({"_side": F.lit(1), "_tie": F.col(tie)})
    both = facts.unionByName(dim, allowMissingColumns=True)
    seen = timeline(both, by, order=(at, "_side", "_tie"), max_rows=max_rows).scan(_known=last("_value"))
    return seen.rows().where("_side = 1").select(
        *df.columns, *[F.col(f"_known.{c}").alias(c) for c in columns])


def asof_name(df: DataFrame, names: DataFrame, key: str = "_pid", max_rows: int | None = None) -> DataFrame:
    """Process name valid at the event's time; ``names``: key, _time, name. Unknown is ``<...>``."""
    out = asof(df, names, [key], ["name"], max_rows=max_rows)
    return out.withColumn("name", F.coalesce("name", F.lit("<...>")))


def floor_lookup(df: DataFrame, addr: str, table: DataFrame, start: str = "start",
                 columns: Sequence[str] = ("name",), by: Sequence[str] = ()) -> DataFrame:
    """For each address the table row with the largest ``start`` not above it (addresses are unsigned) and equal ``by``.

    Distinct addresses are looked up once - there are as many as code locations, not as events - and joined back. Both sides
    are dealt out by pages of PAGE_BITS address bits: an address takes the last table row before it in its page, in one ordered
    pass, or the one carried into the page, which is the same lookup among the pages one level up. No step orders more than
    a page. Of table rows with the same start the largest counts. Null addresses and null ``by`` find nothing.
    """
    value = F.struct(F.col(start).alias("_start"), *columns)
    whole = F.lit(True)
    for c in ["_k", *by]:
        whole = whole & F.col(c).isNotNull()
    keyed = table.select(*by, F.col(start).bitwiseXOR(F.lit(SIGN)).alias("_k"), value.alias("_known")).where(whole)
    entries = keyed.groupBy(*by, "_k").agg(F.max("_known").alias("_known"))
    wanted = df.select(*by, F.col(addr).bitwiseXOR(F.lit(SIGN)).alias("_k")).where(whole).distinct()
    found = _predecessors(wanted, entries, list(by), 0, 0).select(*by, F.col("_k").bitwiseXOR(F.lit(SIGN)).alias(addr), "_known")
    return df.join(found, [*by, addr], "left").select(
        *df.columns, F.col("_known._start").alias("_start"), *[F.col(f"_known.{c}").alias(c) for c in columns])


def _predecessors(wanted: DataFrame, entries: DataFrame, by: list[str], level: int, less: int) -> DataFrame:
    """``wanted`` (by, _k, distinct) with the _known of the largest entry _k not above ``_k - less``, or NULL."""
    page = F.shiftright("_k", PAGE_BITS) if level < LEVELS - 1 else F.lit(0)
    asked = wanted.withColumn("_page", page)
    # Of the same _k, the entry comes before the address that may take it, or after the one that may not.
    rows = entries.select(*by, "_k", "_known", page.alias("_page"), F.lit(less).alias("_side")).unionByName(
        asked.select(*by, "_k", "_page", F.lit(1 - less).alias("_side")), allowMissingColumns=True)
    upto = Window.partitionBy(*by, "_page").orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_known", F.last("_known", ignorenulls=True).over(upto)).where(F.col("_side") == 1 - less)
    here = here.select(*by, "_k", "_page", "_known")
    if level == LEVELS - 1:
        return here.select(*by, "_k", "_known")
    # The last entry of each page stands for it one level up.
    upper = entries.groupBy(*by, page.alias("_k")).agg(F.max_by("_known", "_k").alias("_known"))
    carried = _predecessors(asked.select(*by, F.col("_page").alias("_k")).distinct(), upper, by, level + 1, 1)
    carried = carried.select(*by, F.col("_k").alias("_page"), F.col("_known").alias("_carried"))
    return here.join(carried, [*by, "_page"]).select(*by, "_k", F.coalesce("_known", "_carried").alias("_known"))


def _distance(addr: Column, start: Column) -> Column:
    """Unsigned ``addr - start`` for start <= addr; NULL when it does not fit a BIGINT."""
    low, most = addr.bitwiseAND(F.lit(MOST)), F.lit(MOST)
    across = F.when(low < start, (most - start) + (low + 1))
    return F.when((addr < 0) & (start >= 0), across).otherwise(addr - start)


def symbolize(df: DataFrame, addr: str, symbols: DataFrame, length: str | None = None,
              unknown: str = "??", max_rows: int | None = None) -> DataFrame:
    """Add ``symbol`` and ``offset``; ``symbols``: start, name[, length].

    ``max_rows`` is accepted as by the other lookups; pages bound the rows of a task without it.
    """
    cols = ["name"] + ([length] if length else [])
    out = floor_lookup(df, addr, symbols, "start", cols)
    offset = _distance(F.col(addr), F.col("_start"))
    known = F.col("_start").isNotNull()
    if length:
        known = known & (offset < F.col(length))
    return out.withColumns({
        "symbol": F.when(known, F.col("name")).otherwise(F.lit(unknown)),
        "offset": F.when(known, offset),
    }).drop("name", "_start", *([length] if length else []))


def in_symbol(df: DataFrame, addr: str | Column, symbols: DataFrame, name: str) -> DataFrame:
    """Rows whose address lies in a function of this name: ``start <= addr < end``, for any number of ranges."""
    ranges = symbols.where(F.col("name") == name).select(F.col("start").alias("__lo"), (F.col("end") - 1).alias("__hi"))
    rows = df.withColumn("__addr", as_column(addr))
    return range_join(rows, ranges, "__addr", "__lo", "__hi", how="left_semi").select(*df.columns)


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], column: str, default: str = "??") -> DataFrame:
    """Name from a dimension table; Catalyst broadcasts it when its size allows."""
    return df.join(dim, list(on), "left").withColumn(column, F.coalesce(column, F.lit(default)))
