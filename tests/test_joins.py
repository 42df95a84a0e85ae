"""Range, overlap, as-of and floor joins against brute force."""

from __future__ import annotations

import bisect
import random

import pytest
from conftest import random_events, rows_of
from pyspark.sql import functions as F

from eventframe.operators import context as cx
from eventframe.operators import pairs as pr
from eventframe.operators import rangejoin
from eventframe.operators.enrich import asof_name, floor_lookup, in_symbol, symbolize
from eventframe.operators.rangejoin import overlap_join, range_join

LENGTHS = [0, 0, 1, 15, 16, 17, 255, 256, 5000]


def spans_and_points(spark, seed):
    rng = random.Random(seed)
    spans = [(i, rng.randrange(2), s := rng.randrange(-3000, 6000), s + rng.choice(LENGTHS)) for i in range(80)]
    points = [(i, rng.randrange(2), rng.randrange(-3500, 9000)) for i in range(300)] + [(999, 0, spans[0][2])]
    return (spans, points, spark.createDataFrame(spans, "sid int, sk int, s bigint, e bigint"),
            spark.createDataFrame(points, "pid int, pk int, t bigint"))


def test_range_join(spark):
    spans, points, s, p = spans_and_points(spark, 1)
    want = sorted((b[0], a[0]) for a in spans for b in points if a[1] == b[1] and a[2] <= b[2] <= a[3])
    assert rows_of(range_join(p, s, "t", "s", "e", [("pk", "sk")]), "pid", "sid") == want
    hit = {w[0] for w in want}
    semi = range_join(p, s, "t", "s", "e", [("pk", "sk")], how="left_semi")
    anti = range_join(p, s, "t", "s", "e", [("pk", "sk")], how="left_anti")
    assert [r[0] for r in rows_of(semi, "pid")] == sorted(hit)
    assert [r[0] for r in rows_of(anti, "pid")] == sorted(x[0] for x in points if x[0] not in hit)
    plan = range_join(p, s, "t", "s", "e")._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan


def test_overlap_join(spark):
    rng = random.Random(2)
    make = lambda: [(i, s := rng.randrange(500), s + rng.choice([0, 1, 5, 40, 300])) for i in range(60)]
    a, b = make(), make()
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    da = spark.createDataFrame(a, "a int, a0 bigint, a1 bigint")
    db = spark.createDataFrame(b, "b int, b0 bigint, b1 bigint")
    assert rows_of(overlap_join(da, db, ("a0", "a1"), ("b0", "b1")), "a", "b") == want


@pytest.mark.parametrize("rows", [10, 1_000])
def test_overlap_join_of_two_large_tables_broadcasts_neither(spark, monkeypatch, rows):
    monkeypatch.setattr(rangejoin, "BROADCAST_ROWS", rows)
    rng = random.Random(3)
    far = 1 << 62
    make = lambda: [(i, rng.randrange(2), s := rng.choice([-far, -5, 0, far - 900]) + rng.randrange(700),
                     s + rng.choice([0, 1, 3, 4, 15, 16, 17, 200, far - 1, far, far + 1])) for i in range(60)]
    a, b = make(), make()
    a, b = [x for x in a if x[3] < 2 * far], [x for x in b if x[3] < 2 * far]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    da = spark.createDataFrame(a, "a int, ak int, a0 bigint, a1 bigint")
    db = spark.createDataFrame(b, "b int, bk int, b0 bigint, b1 bigint")
    out = overlap_join(da, db, ("a0", "a1"), ("b0", "b1"), [("ak", "bk")])
    assert rows_of(out, "a", "b") == want
    assert ("strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()) == (rows == 10)


@pytest.mark.parametrize("max_rows", [None, 20])
def test_symbols(spark, max_rows):
    starts = [16, 100, 100 + (1 << 63) - (1 << 64), -1000]
    symbols = spark.createDataFrame([(s, f"f{i}", 50) for i, s in enumerate(starts)], "start bigint, name string, len bigint")
    addrs = [0, 15, 16, 17, 99, 100, 149, 150, (1 << 63) - 1, -(1 << 63), -(1 << 63) + 100, -1000, -1, 16, 16]

    def want(a, limited):
        best = max((s for s in starts if s % (1 << 64) <= a % (1 << 64)), key=lambda s: s % (1 << 64), default=None)
        if best is None or (limited and (a - best) % (1 << 64) >= 50):
            return "??"
        return f"f{starts.index(best)}"
    df = spark.createDataFrame(list(enumerate(addrs)), "i int, addr bigint")
    for length in (None, "len"):
        got = symbolize(df, "addr", symbols, length=length, max_rows=max_rows)
        assert rows_of(got, "i", "symbol") == [(i, want(a, bool(length))) for i, a in enumerate(addrs)]


@pytest.mark.parametrize("n", [300, 3_000])
def test_symbols_by_page(spark, n):
    """Dense and empty pages, both ends of the address space, equal starts; predecessors carried over many pages."""
    rng = random.Random(n)
    near = lambda: rng.choice([0, 1 << 20, 1 << 33, 1 << 50, (1 << 63) - 40, 1 << 63, (1 << 64) - 9_000]) + rng.randrange(9_000)
    starts = [near() for _ in range(n)] + [1 << 20, 1 << 20]
    addrs = [near() if rng.random() < 0.8 else rng.randrange(1 << 64) for _ in range(n)]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    table = spark.createDataFrame([(signed(s), f"f{s}") for s in starts], "start bigint, name string")
    df = spark.createDataFrame([(i, signed(a)) for i, a in enumerate(addrs)] + [(n, None)], "i int, addr bigint")
    got = {r["i"]: r["name"] for r in floor_lookup(df, "addr", table).collect()}
    below = sorted(starts)
    want = {i: f"f{below[k - 1]}" if (k := bisect.bisect_right(below, a)) else None for i, a in enumerate(addrs)}
    assert got == want | {n: None}
    assert floor_lookup(df, "addr", table.limit(0)).where("name IS NOT NULL").count() == 0


def test_in_symbol(spark):
    df = spark.createDataFrame([(9,), (10,), (19,), (20,)], "addr bigint")
    table = spark.createDataFrame([("f", 10, 20), ("g", 20, 30)], "name string, start bigint, end bigint")
    assert rows_of(in_symbol(df, "addr", table, "f")) == [(10,), (19,)]


@pytest.mark.parametrize("max_rows", [None, 15])
def test_names_as_of(spark, make, max_rows):
    events = random_events(3, 200, "an", 4)
    known, want = {}, []
    for i, (e, t, k, *_) in enumerate(events):
        if e == "n":
            known.setdefault(k, []).append((t, i))
    for i, (e, t, k, *_) in enumerate(events):
        if e == "a":
            past = [x for x in known.get(k, []) if x[0] <= t]
            want.append((i, f"n{past[-1][1]}" if past else "<...>"))
    df = make(events)
    names = df.where("event = 'n'").select("_pid", "_time", "seq", F.concat(F.lit("n"), "seq").alias("name"))
    assert rows_of(asof_name(df.where("event = 'a'"), names, max_rows=max_rows), "seq", "name") == want


def test_context(make):
    events = random_events(4, 250, "acx", 4)
    df = make(events)
    pairs = pr.pair_events(df, [["a"], ["c"]])
    got = cx.context(pairs, df, before=3, after=2, same="cpu")
    want = []
    for p in pairs.collect():
        for i, (e, t, k, cpu) in enumerate(events):
            if p["start_time"] - 3 <= t <= p["end_time"] + 2 and cpu in (p["start_cpu"], p["end_cpu"]):
                want.append((p["end_id"], i))
    assert rows_of(got, "pair_id", "seq") == sorted(want)
    moved = df.withColumn("_pid", F.expr("_tid % 2 + 100"))
    pairs = pr.pair_events(moved, [["a"], ["c"]], carry=("_pid",))
    got = cx.context(pairs, moved, before=3, after=2, same=("pid", "cpu"), side=(2,), than=4, lower=2)
    want = [(p["end_id"], i) for p in pairs.collect() if p["latency"] > 4 or p["latency"] < 2 for i, (e, t, k, cpu) in enumerate(events)
            if p["start_time"] - 3 <= t <= p["end_time"] + 2 and (cpu == p["end_cpu"] or k % 2 + 100 == p["end__pid"])]
    assert rows_of(got, "pair_id", "seq") == sorted(want)
    with pytest.raises(ValueError, match="carry"):
        cx.context(pairs.drop("end__pid"), moved, same="pid")
    one = cx.context(pairs, df, same="key", key="_tid")
    assert {r["part"] for r in one.collect()} >= {"start", "end"}


def test_hide(spark):
    times = [0, 1, 2, 20, 30, 31, 50, 51, 52]
    rows = spark.createDataFrame([(7, "between", t, i, "e", t) for i, t in enumerate(times)],
                                 "pair_id bigint, part string, _time bigint, seq bigint, event string, offset bigint")
    for max_rows in (None, 3):
        got = rows_of(cx.hide_close(rows, 5, max_rows=max_rows), "seq", "hidden")
        # 0 (1 hidden) 2 | 20 | 30 31 | 50, then two hidden to the end.
        assert got == [(None, 2), (0, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0)]


def test_in_symbol_many_ranges(spark):
    table = spark.range(1500).selectExpr("id * 10 AS start", "id * 10 + 4 AS end", "'f' AS name")
    df = spark.range(0, 15000, 7).withColumnRenamed("id", "addr")
    got = {r[0] for r in in_symbol(df, "addr", table, "f").collect()}
    assert got == {a for a in range(0, 15000, 7) if a % 10 < 4}


@pytest.mark.parametrize("n", [80, 800])
def test_context_follows_a_migrating_task(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice("abcm"), t, t, rng.randrange(3), 0, rng.randrange(6), rng.randrange(3)) for t in range(n)]
    df = spark.createDataFrame(rows, "event string, _time bigint, seq bigint, _cpu int, _pid bigint, _tid bigint, dest int")
    pairs = pr.pair_events(df, [["a"], ["b"]])

    def on(tid, t, start_cpu):
        moved = [r[6] for r in rows if r[0] == "m" and r[5] == tid and r[1] <= t]
        return moved[-1] if moved else start_cpu

    want = sorted((p["end_id"], r[2]) for p in pairs.collect() for r in rows
                  if p["start_time"] - 3 <= r[1] <= p["end_time"] + 2 and r[3] == on(p["start_tid"], r[1], p["start_cpu"]))
    got = cx.context_on_cpu(pairs, df, {"m": ("_tid", "dest")}, before=3, after=2)
    assert rows_of(got, "pair_id", "seq") == want
