"""Canonical event columns and small helpers shared by every operator.

An *events frame* is any DataFrame with these columns plus free payload columns:

    event STRING    event type
    _time BIGINT    nanoseconds
    seq   BIGINT    arrival number, breaks ties in time
    _cpu INT, _pid BIGINT, _tid BIGINT   the instance the event was recorded on
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_COLUMNS = ("event", "_time", "seq", "_cpu", "_pid", "_tid")
ORDER = ("_time", "seq")

# Nanoseconds per unit suffix.
UNIT_NS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}


def ns(duration: str | int) -> int:
    """Duration with unit to nanoseconds: ``ns("10ms") == 10_000_000``; plain numbers are ns."""
    if isinstance(duration, int):
        return duration
    m = re.fullmatch(r"\s*(-?\d+)\s*(s|ms|us|ns)?\s*", duration)
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m.group(1)) * UNIT_NS[m.group(2) or "ns"]


def as_column(c: str | Column) -> Column:
    """A Column as is; a string as a SQL expression (a plain column name is one too)."""
    return c if isinstance(c, Column) else F.expr(c)


def per_event(spec: str | Column | Mapping[str, str | Column], name: str = "event",
              default: str | Column | None = None) -> Column:
    """One expression for all events, or a mapping ``{event: expression}`` with an optional default."""
    if not isinstance(spec, Mapping):
        return as_column(spec)
    out = None
    for event, expr in spec.items():
        cond = F.col(name) == F.lit(event)
        out = F.when(cond, as_column(expr)) if out is None else out.when(cond, as_column(expr))
    if out is None:
        raise ValueError("empty mapping")
    return out.otherwise(as_column(default)) if default is not None else out


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              broadcast: bool = False) -> DataFrame:
    """Null-safe equi-join on equally named columns, keeping the left ones."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = all_of([F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, on, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def epoch_ns(ts: str | Column) -> Column:
    """Wall-clock TIMESTAMP_NTZ to ns since 1970, whatever the session time zone is."""
    local = as_column(ts).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(local, F.current_timezone())) * F.lit(1000)


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """``"0-3,7"`` to ``[(0, 3), (7, 7)]`` (cpu, pid and tid lists)."""
    out = []
    for item in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", item)
        if not m:
            raise ValueError(f"bad range list: {text!r}")
        lo = int(m.group(1))
        out.append((lo, int(m.group(2) or lo)))
    return out
