"""Predicates and scalar helpers, all built from JVM-side Spark functions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import any_of, as_column, parse_ranges


def glob_regex(pattern: str) -> str:
    """Java regex for a case-sensitive, whole-string glob: ``* ? [abc] [a-z] [!x] [^x]``."""
    parts = []
    for m in re.finditer(r"\*+|\?|\[([!^]?)([^\]]*)(?:\]|\Z)|.", pattern, re.S):
        token = m.group(0)
        if token[0] == "*":
            parts.append(".*")
        elif token == "?":
            parts.append(".")
        elif token[0] == "[":
            parts.append(_char_class(m.group(2), negated=bool(m.group(1))))
        else:
            parts.append(_literal(token))
    return r"(?s)\A" + "".join(parts) + r"\z"


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch in "_ " else f"\\x{{{ord(ch):x}}}"


def _char_class(body: str, negated: bool) -> str:
    items = []
    for m in re.finditer(r"(.)-(.)|(.)", body, re.S):
        if m.group(3) is not None:
            items.append(_literal(m.group(3)))
        elif m.group(1) <= m.group(2):
            items.append(f"{_literal(m.group(1))}-{_literal(m.group(2))}")
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def glob(col: str | Column, pattern: str) -> Column:
    return as_column(col).rlike(glob_regex(pattern))


def glob_any(col: str | Column, patterns: str) -> Column:
    """Comma-separated names or globs, e.g. ``"java,py*"``."""
    c = as_column(col)
    return any_of([glob(c, p.strip()) for p in patterns.split(",") if p.strip()])


def in_cpulist(col: str | Column, cpus: str) -> Column:
    """Membership in a list such as ``"0-3,7"``, as range predicates that reach the scan."""
    c = as_column(col)
    return any_of([c == lo if lo == hi else c.between(lo, hi) for lo, hi in parse_ranges(cpus)])


def has_bits(col: str | Column, mask: int) -> Column:
    return as_column(col).bitwiseAND(F.lit(mask)) != 0


def strncmp(a: str | Column, b: str | Column, n: int) -> Column:
    """-1, 0 or 1 for the byte-wise order of the first n characters."""
    x, y = F.substring(as_column(a), 1, n), F.substring(as_column(b), 1, n)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0).cast("int")


def printf(fmt: str, *cols: str | Column) -> Column:
    if len(cols) > 6:
        raise ValueError("printf takes at most 6 arguments")
    return F.format_string(fmt, *[as_column(c) for c in cols])


def int_div(a: str | Column, b: str | Column) -> Column:
    """Integer division truncating toward zero; NULL on division by zero."""
    x, y = as_column(a), as_column(b)
    return F.call_function("div", x, F.nullif(y, F.lit(0)))


def compound_key(hi: str | Column, lo: str | Column) -> Column:
    """``(hi << 32) | lo`` as BIGINT."""
    return F.shiftleft(as_column(hi).cast("bigint"), 32).bitwiseOR(as_column(lo).cast("bigint"))


def key_parts(key: str | Column) -> tuple[Column, Column]:
    k = as_column(key)
    return F.shiftright(k, 32), k.bitwiseAND(F.lit(0xFFFFFFFF))


def ntohl(col: str | Column) -> Column:
    """Byte swap of an unsigned 32-bit value held in a BIGINT."""
    x = as_column(col).cast("bigint")
    byte = [F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    out = F.shiftleft(byte[0], 24)
    for i, shift in ((1, 16), (2, 8), (3, 0)):
        out = out.bitwiseOR(F.shiftleft(byte[i], shift))
    return out


def ntohs(col: str | Column) -> Column:
    x = as_column(col).cast("bigint")
    lo, hi = x.bitwiseAND(F.lit(255)), F.shiftright(x, 8).bitwiseAND(F.lit(255))
    return F.shiftleft(lo, 8).bitwiseOR(hi)


def lookup(col: str | Column, mapping: Mapping, default: str) -> Column:
    """Value from a small fixed dictionary (symbolic names of an enum field), else the default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[as_column(col)], F.lit(default))
