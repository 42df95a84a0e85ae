"""The scalar functions as temporary SQL functions, so that SQL statements can call them by name.

They are SQL expressions that Catalyst inlines - no user code runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def _octets(shifts: tuple[int, ...]) -> str:
    return "concat_ws('.', " + ", ".join(f"(shiftright(n, {s}) & 255)" for s in shifts) + ")"


def _groups(parts: list[list[int]]) -> str:
    cut = ["concat(" + ", ".join(f"substring(h, {2 * i + 1}, 2)" for i in g) + ")" for g in parts]
    return f"lower(concat_ws('-', {', '.join(cut)}))"


def _squeeze() -> str:
    """Compress the leftmost longest run of zero groups in ``:g0:...:g7:``."""
    cases = []
    for n in range(8, 1, -1):
        run = ":0" * n + ":"
        cases.append(f"WHEN instr(p, '{run}') > 0 THEN concat(substring(p, 2, instr(p, '{run}') - 2), '::', "
                     f"rtrim(':', substring(p, instr(p, '{run}') + {len(run)})))")
    return "CASE " + " ".join(cases) + " ELSE trim(':', p) END"


_TAIL = "concat_ws('.', " + ", ".join(f"conv(substring(h, {i}, 2), 16, 10)" for i in (25, 27, 29, 31)) + ")"
_LAST4 = [8, 9], [10, 11, 12, 13, 14, 15]

# name -> (parameters, result type, body); helpers first. Arguments are evaluated before a CASE guards them, so they are
# cut to a length that fits whatever the input is.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "ntohl": ("x BIGINT", "BIGINT", "shiftleft(x & 255, 24) | shiftleft(shiftright(x, 8) & 255, 16) | "
                                    "shiftleft(shiftright(x, 16) & 255, 8) | (shiftright(x, 24) & 255)"),
    "ntohs": ("x BIGINT", "BIGINT", "shiftleft(x & 255, 8) | (shiftright(x, 8) & 255)"),
    "strncmp": ("a STRING, b STRING, n INT", "INT",
                "CASE WHEN substring(a, 1, n) < substring(b, 1, n) THEN -1 WHEN substring(a, 1, n) > substring(b, 1, n) "
                "THEN 1 ELSE 0 END"),
    "ef_ipv4": ("n BIGINT", "STRING", _octets((24, 16, 8, 0))),
    "ef_ipv4_host": ("n BIGINT", "STRING", _octets((0, 8, 16, 24))),
    "ipv4_str": ("b BINARY", "STRING", "CASE WHEN octet_length(b) = 4 THEN ef_ipv4(cast(conv(substring(hex(b), 1, 8), 16, 10) AS BIGINT)) "
                                       "WHEN b IS NOT NULL THEN '??' END"),
    "ipv4_hstr": ("b BINARY", "STRING", "CASE WHEN octet_length(b) = 4 THEN "
                                        "ef_ipv4_host(cast(conv(substring(hex(b), 1, 8), 16, 10) AS BIGINT)) WHEN b IS NOT NULL THEN '??' END"),
    "ef_groups": ("h STRING", "STRING", "concat(':', array_join(transform(sequence(0, 7), i -> coalesce(nullif(ltrim('0', "
                                        "lower(substring(h, i * 4 + 1, 4))), ''), '0')), ':'), ':')"),
    "ef_squeeze": ("p STRING", "STRING", _squeeze()),
    "ef_ipv6": ("h STRING", "STRING",
                f"CASE WHEN startswith(h, repeat('0', 24)) AND NOT startswith(h, repeat('0', 28)) THEN concat('::', {_TAIL}) "
                f"WHEN startswith(h, concat(repeat('0', 20), 'FFFF')) THEN concat('::ffff:', {_TAIL}) "
                "ELSE ef_squeeze(ef_groups(h)) END"),
    "ipv6_str": ("b BINARY", "STRING", "CASE WHEN octet_length(b) = 16 THEN ef_ipv6(hex(b)) WHEN b IS NOT NULL THEN '??' END"),
    "ef_socket": ("h STRING, host BOOLEAN", "STRING",
                  "CASE WHEN substring(h, 1, 4) = '0200' AND length(h) >= 32 THEN concat(CASE WHEN host THEN "
                  "ef_ipv4_host(cast(conv(substring(h, 9, 8), 16, 10) AS BIGINT)) ELSE "
                  "ef_ipv4(cast(conv(substring(h, 9, 8), 16, 10) AS BIGINT)) END, ':', conv(substring(h, 5, 4), 16, 10)) "
                  "WHEN substring(h, 1, 4) = '0A00' AND length(h) >= 56 THEN concat('[', ef_ipv6(substring(h, 17, 32)), "
                  "']:', conv(substring(h, 5, 4), 16, 10)) WHEN h IS NOT NULL THEN '??' END"),
    "ipsa_str": ("b BINARY", "STRING", "ef_socket(hex(b), false)"),
    "ipsa_hstr": ("b BINARY", "STRING", "ef_socket(hex(b), true)"),
    "ef_uuid": ("h STRING", "STRING", _groups([[0, 1, 2, 3], [4, 5], [6, 7], *_LAST4])),
    "ef_guid": ("h STRING", "STRING", _groups([[3, 2, 1, 0], [5, 4], [7, 6], *_LAST4])),
    "uuid_str": ("b BINARY", "STRING", "CASE WHEN octet_length(b) = 16 THEN ef_uuid(hex(b)) WHEN b IS NOT NULL THEN '??' END"),
    "guid_str": ("b BINARY", "STRING", "CASE WHEN octet_length(b) = 16 THEN ef_guid(hex(b)) WHEN b IS NOT NULL THEN '??' END"),
    "mac_str": ("b BINARY", "STRING", "CASE WHEN octet_length(b) = 6 THEN lower(regexp_replace(hex(b), '(..)(?=.)', '$1:')) "
                                      "WHEN b IS NOT NULL THEN '??' END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns the names meant for users."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [n for n in FUNCTIONS if not n.startswith("ef_")]


def register_symbols(spark: SparkSession, name: str, mapping: Mapping[int, str], default: str = "UNKNOWN") -> None:
    """An enum field's names as an SQL function, e.g. ``syscall(nr)`` with default ``??``."""
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cases = " ".join(f"WHEN {int(k)} THEN {text(v)}" for k, v in mapping.items())
    body = f"CASE v {cases} ELSE {text(default)} END" if mapping else text(default)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v BIGINT) RETURNS STRING RETURN {body}")
