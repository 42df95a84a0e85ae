"""Composite predicates over event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import all_of, as_column, parse_ranges, any_of
from .text import glob_any, in_cpulist


def comm_filter(names: str | None = None, pids: str | None = None, name: str = "comm",
                pid: str = "_pid") -> Column:
    """Process names (comma list with wildcards) and/or pid ranges; either may match."""
    conds = []
    if names:
        conds.append(glob_any(name, names))
    if pids:
        conds.append(any_of([F.col(pid).between(lo, hi) for lo, hi in parse_ranges(pids)]))
    return any_of(conds) if conds else F.lit(True)


def context_filter(df: DataFrame, irqs_disabled: int | None = None, tif_need_resched: int | None = None,
                   exclude_pid: int | None = None, nr_running_min: int | None = None,
                   nr_running_max: int | None = None, sched_policy: int | None = None, prio: str | None = None,
                   exclude_user: bool = False, exclude_kernel: bool = False, exclude_guest: bool = False,
                   exclude_host: bool = False) -> DataFrame:
    """Predicates on recorded context columns of the same names, plus mode exclusion on ``cpumode``."""
    conds = []
    for column, value in (("irqs_disabled", irqs_disabled), ("tif_need_resched", tif_need_resched),
                          ("sched_policy", sched_policy)):
        if value is not None:
            conds.append(F.col(column) == value)
    if exclude_pid is not None:
        conds.append(F.col("_pid") != exclude_pid)
    if nr_running_min is not None:
        conds.append(F.col("nr_running") >= nr_running_min)
    if nr_running_max is not None:
        conds.append(F.col("nr_running") <= nr_running_max)
    if prio is not None:
        conds.append(in_cpulist("prio", prio))
    excluded = [m for m, off in (("user", exclude_user), ("kernel", exclude_kernel)) if off]
    if exclude_guest:
        excluded += ["guest_user", "guest_kernel"]
    if exclude_host:
        excluded += [m for m in ("user", "kernel") if m not in excluded]
    if excluded:
        conds.append(~F.col("cpumode").isin(excluded))
    return df.where(all_of(conds))


def derive(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Derived columns (key, num, size, ptr, name, role, ...) as expressions over the payload."""
    return df.withColumns({n: as_column(e) for n, e in columns.items() if e is not None})
