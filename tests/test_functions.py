"""Scalar functions against the standard library."""

from __future__ import annotations

import ipaddress
import random
import uuid

import pytest
from pyspark.sql import functions as F

from eventframe.functions import net, text
from eventframe.functions.quantiles import distribution
from eventframe.functions.sql import register_functions, register_symbols
from eventframe.schema import ns, parse_ranges


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


GLOBS = [
    ("abc", "abc", 1), ("abc", "ab", 0), ("abc", "*", 1), ("", "*", 1), ("", "", 1), ("a", "", 0), ("abc", "a*c", 1),
    ("abc", "**c", 1), ("abc", "a?c", 1), ("ac", "a?c", 0), ("abc", "[a-c]bc", 1), ("dbc", "[a-c]bc", 0),
    ("dbc", "[!a-c]bc", 1), ("abc", "[^a]bc", 0), ("a.c", "a.c", 1), ("abc", "a.c", 0), ("a+(c", "a+(c", 1),
    ("a\\c", "a\\c", 1), ("ABC", "abc", 0), ("a-c", "a[a-]c", 1), ("a]c", "a[]]c", 0), ("xa\nb", "x*b", 1), ("a^", "a[x^]", 1),
    ("abcabd", "*ab[d]", 1), ("ab", "[z-a]b", 0), ("a", "[!]", 1),
]


def test_glob(spark):
    for value, pattern, want in GLOBS:
        got = one(spark, g=text.glob(F.lit(value), pattern).cast("int"))["g"]
        assert got == want, (value, pattern)


def test_numbers(spark):
    r = one(spark, a=text.ntohl(F.lit(0x01020304)), b=text.ntohs(F.lit(0x0102)), c=text.int_div(F.lit(-7), F.lit(2)),
            d=text.strncmp(F.lit("abcx"), F.lit("abcy"), 3), e=text.strncmp(F.lit("ab"), F.lit("abc"), 3),
            f=text.compound_key(F.lit(3), F.lit(5)), g=text.int_div(F.lit(1), F.lit(0)),
            h=text.in_cpulist(F.lit(7), "0-3,7"), i=text.in_cpulist(F.lit(5), "0-3,7"),
            j=text.lookup(F.lit(2), {1: "one"}, "UNKNOWN"), k=text.has_bits(F.lit(6), 1))
    assert tuple(r) == (0x04030201, 0x0201, -3, 0, -1, (3 << 32) | 5, None, True, False, "UNKNOWN", False)
    assert (ns("10ms"), ns("2s"), ns("3us"), ns("4"), ns(5)) == (10_000_000, 2_000_000_000, 3000, 4, 5)
    assert parse_ranges("0-3, 7") == [(0, 3), (7, 7)]
    with pytest.raises(ValueError):
        ns("10 minutes")
    with pytest.raises(ValueError):
        text.printf("%d", *[F.lit(1)] * 7)


def random_v6(rng):
    return b"".join((b"\0\0" if rng.random() < 0.6 else rng.randbytes(2)) for _ in range(8))


def v6_text(raw: bytes) -> str:
    """Reference text: zero run compression plus dotted tail for embedded IPv4."""
    a = ipaddress.IPv6Address(raw)
    groups = [int.from_bytes(raw[i:i + 2], "big") for i in range(0, 16, 2)]
    tail = str(ipaddress.IPv4Address(raw[12:]))
    if groups[:5] == [0] * 5 and groups[5] == 0xFFFF:
        return f"::ffff:{tail}"
    if groups[:6] == [0] * 6 and groups[6]:
        return f"::{tail}"
    return a.compressed


def test_addresses(spark):
    rng = random.Random(1)
    v6 = [random_v6(rng) for _ in range(300)] + [bytes(16), bytes(15) + b"\1", b"\xff" * 16,
                                                bytes(10) + b"\xff\xff\1\2\3\4", bytes(12) + b"\1\2\3\4"]
    got = spark.createDataFrame([(b,) for b in v6], "b binary").select("b", net.ipv6_str("b").alias("t")).collect()
    for r in got:
        assert r["t"] == v6_text(bytes(r["b"]))
    rows = [(rng.randbytes(4), rng.randbytes(16), rng.randbytes(6)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a binary, u binary, m binary")
    for r in df.select("*", net.ipv4_str("a").alias("ip"), net.ipv4_hstr("a").alias("hip"), net.uuid_str("u").alias("id"),
                       net.guid_str("u").alias("guid"), net.mac_str("m").alias("mac")).collect():
        assert r["ip"] == str(ipaddress.IPv4Address(bytes(r["a"])))
        assert r["hip"] == str(ipaddress.IPv4Address(bytes(r["a"])[::-1]))
        assert r["id"] == str(uuid.UUID(bytes=bytes(r["u"])))
        assert r["guid"] == str(uuid.UUID(bytes_le=bytes(r["u"])))
        assert r["mac"] == bytes(r["m"]).hex(":")


def test_socket_addresses(spark):
    v4 = bytes([2, 0, 0x1F, 0x90, 10, 0, 0, 1]) + bytes(8)
    v6 = bytes([10, 0, 0x01, 0xBB]) + bytes(4) + ipaddress.IPv6Address("fe80::1").packed + bytes(4)
    bad = [b"", bytes(4), v4[:8], v6[:20], bytes([1, 0]) + bytes(14)]
    df = spark.createDataFrame([(b,) for b in [v4, v6, *bad, None]], "b binary")
    got = [tuple(r) for r in df.select(net.ipsa_str("b"), net.ipsa_hstr("b")).collect()]
    assert got == [("10.0.0.1:8080", "1.0.0.10:8080"), ("[fe80::1]:443", "[fe80::1]:443"), *[("??", "??")] * 5, (None, None)]
    wrong = one(spark, a=net.ipv4_str(F.lit(b"abc")), b=net.ipv6_str(F.lit(b"abc")), c=net.uuid_str(F.lit(b"abc")),
                d=net.mac_str(F.lit(b"abc")))
    assert set(wrong) == {"??"}


def test_distribution_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.randrange(-10, 10), rng.randrange(1 << 40), -rng.randrange(1 << 20), 777_777]) for _ in range(3000)]
    df = spark.createDataFrame([("h" if i % 4 else None, v) for i, v in enumerate(values)], "g string, v bigint")
    probs = {"p1": "0.01", "p50": "0.5", "p999": "0.999"}
    for r in distribution(df, ["g"], "v", probs, than=100).collect():
        mine = sorted(v for i, v in enumerate(values) if ("h" if i % 4 else None) == r["g"])
        n = len(mine)
        assert (r["calls"], r["total"], r["min"], r["max"]) == (n, sum(mine), mine[0], mine[-1])
        assert (r["p1"], r["p50"], r["p999"]) == tuple(mine[-(-n * k // 1000) - 1] for k in (10, 500, 999))
        assert r["than"] == sum(v > 100 for v in mine)


def test_sql_functions_agree_with_columns(spark):
    names = register_functions(spark)
    assert {"ipv4_str", "ipv6_str", "ipsa_hstr", "guid_str", "ntohl"} <= set(names)
    rng = random.Random(4)
    v4 = bytes([2, 0, 0x1F, 0x90, 10, 0, 0, 1]) + bytes(8)
    v6 = bytes([10, 0, 0x01, 0xBB]) + bytes(4) + ipaddress.IPv6Address("fe80::1").packed + bytes(4)
    values = [rng.randbytes(4), rng.randbytes(6), rng.randbytes(16), v4, v6, b"", b"abc", None, bytes(16),
              bytes(10) + b"\xff\xff\1\2\3\4", bytes(12) + b"\1\2\3\4", *[random_v6(rng) for _ in range(60)]]
    df = spark.createDataFrame([(b,) for b in values], "b binary")
    for name in ("ipv4_str", "ipv4_hstr", "ipv6_str", "ipsa_str", "ipsa_hstr", "uuid_str", "guid_str", "mac_str"):
        for r in df.select("b", F.expr(f"{name}(b)").alias("s"), getattr(net, name)("b").alias("c")).collect():
            assert r["s"] == r["c"], (name, r)
    register_symbols(spark, "state_name", {1: "it's", 2: "two"})
    assert tuple(spark.sql("SELECT state_name(1), state_name(2), state_name(9), ntohl(16909060)").first()) == (
        "it's", "two", "UNKNOWN", 67305985)
