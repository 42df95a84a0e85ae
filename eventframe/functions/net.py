"""Network address and identifier formatting on BINARY columns.

A value of the wrong length formats as ``??``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import as_column

UNKNOWN = "??"
# Address family numbers and socket address sizes in bytes.
FAMILY_V4, SIZE_V4 = 2, 16
FAMILY_V6, SIZE_V6 = 10, 28


def _hex(b: Column, byte: int, count: int = 1) -> Column:
    return F.substring(F.hex(b), 2 * byte + 1, 2 * count)


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value bound to a lambda variable: inlined, it would be repeated at every use."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10)


def _sized(b: Column, size: int, text: Column) -> Column:
    return F.when(F.octet_length(b) == size, text).when(b.isNotNull(), F.lit(UNKNOWN))


def _dotted(b: Column, at: int = 0, reverse: bool = False) -> Column:
    order = range(3, -1, -1) if reverse else range(4)
    return F.concat_ws(".", *[_number(_hex(b, at + i)) for i in order])


def _ipv4_text(b: Column, shifts: tuple[int, ...]) -> Column:
    # One hex conversion per value: outside of a CASE branch, codegen shares it between the four octets.
    n = F.conv(F.hex(F.when(F.octet_length(b) == 4, b)), 16, 10).cast("bigint")
    text = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in shifts])
    return F.coalesce(F.nullif(text, F.lit("")), F.when(b.isNotNull(), F.lit(UNKNOWN)))


def ipv4_str(col: str | Column) -> Column:
    """4 bytes in network order."""
    return _ipv4_text(as_column(col), (24, 16, 8, 0))


def ipv4_hstr(col: str | Column) -> Column:
    """4 bytes in (little-endian) host order."""
    return _ipv4_text(as_column(col), (0, 8, 16, 24))


def _ipv6_text(b: Column, at: int = 0) -> Column:
    groups = [F.coalesce(F.nullif(F.lower(F.ltrim(_hex(b, at + 2 * i, 2), F.lit("0"))), F.lit("")), F.lit("0"))
              for i in range(8)]
    tail = _dotted(b, at + 12)

    def compress(padded: Column) -> Column:
        # padded is ":g0:...:g7:"; the leftmost run of n zero groups, longer runs first.
        out = F.when(padded.startswith(":0" * 6 + ":") & ~padded.startswith(":0" * 7 + ":"),
                     F.concat(F.lit("::"), tail))
        out = out.when(padded.startswith(":0" * 5 + ":ffff:"), F.concat(F.lit("::ffff:"), tail))
        for n in range(8, 1, -1):
            run = ":0" * n + ":"
            at = F.instr(padded, run)
            before = F.substring(padded, F.lit(2), at - 2)
            after = F.rtrim(F.substring(padded, at + len(run), F.length(padded)), F.lit(":"))
            out = out.when(at > 0, F.concat(before, F.lit("::"), after))
        return out.otherwise(F.trim(padded, F.lit(":")))

    return _once(F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":")), compress)


def ipv6_str(col: str | Column) -> Column:
    """16 bytes, longest zero run compressed, embedded IPv4 dotted."""
    return _once(as_column(col), lambda b: _sized(b, 16, _ipv6_text(b)))


def _socket_address(col: str | Column, host_order: bool) -> Column:
    return _once(as_column(col), lambda b: _address_text(b, host_order))


def _address_text(b: Column, host_order: bool) -> Column:
    family = _number(F.concat(_hex(b, 1), _hex(b, 0))).cast("int")
    port = _number(_hex(b, 2, 2))
    return (
        F.when((family == FAMILY_V4) & (F.octet_length(b) >= SIZE_V4),
               F.concat(_dotted(b, 4, reverse=host_order), F.lit(":"), port))
        .when((family == FAMILY_V6) & (F.octet_length(b) >= SIZE_V6),
              F.concat(F.lit("["), _ipv6_text(b, 8), F.lit("]:"), port))
        .when(b.isNotNull(), F.lit(UNKNOWN))
    )


def ipsa_str(col: str | Column) -> Column:
    """Socket address to ``ip:port`` or ``[ip6]:port``."""
    return _socket_address(col, host_order=False)


def ipsa_hstr(col: str | Column) -> Column:
    """As :func:`ipsa_str` with the IPv4 address in host order."""
    return _socket_address(col, host_order=True)


def _dashed(b: Column, groups: list[list[int]]) -> Column:
    return F.lower(F.concat_ws("-", *[F.concat(*[_hex(b, i) for i in g]) for g in groups]))


def uuid_str(col: str | Column) -> Column:
    b = as_column(col)
    groups = [[0, 1, 2, 3], [4, 5], [6, 7], [8, 9], [10, 11, 12, 13, 14, 15]]
    return _sized(b, 16, _dashed(b, groups))


def guid_str(col: str | Column) -> Column:
    """First three groups little endian."""
    b = as_column(col)
    groups = [[3, 2, 1, 0], [5, 4], [7, 6], [8, 9], [10, 11, 12, 13, 14, 15]]
    return _sized(b, 16, _dashed(b, groups))


def mac_str(col: str | Column) -> Column:
    b = as_column(col)
    return _sized(b, 6, F.lower(F.regexp_replace(F.hex(b), "(..)(?=.)", "$1:")))
