"""State machines against replays."""

from __future__ import annotations

import random

import pytest
from conftest import random_events, rows_of
from pyspark.sql import functions as F

from eventframe.operators import calls as ca
from eventframe.operators import counting as ct
from eventframe.operators import leaks as lk
from eventframe.operators import states as sm
from eventframe.operators.hotspots import hot_seconds

KIND = {"i": ("in", None), "S": ("out", "S"), "R": ("out", "R"), "X": ("out", "X"), "w": ("wake", None), "n": ("new", None)}


def moves(spark, events):
    return spark.createDataFrame([(k, *KIND[e], t, i) for i, (e, t, k, *_) in enumerate(events)],
                                 "task bigint, kind string, state string, _time bigint, seq bigint")


def replay_states(events):
    now, out = {}, []
    for e, t, k, *_ in events:
        kind, state = KIND[e]
        was = now.get(k)
        sleeping = was and was[0] != "run"
        if kind == "out":
            if was and not sleeping and t > was[1]:
                out.append((k, "R", t - was[1]))
            now[k] = ("run" if state == "R" else state, t)
            if state == "X":
                del now[k]
        elif kind == "in":
            if was and not sleeping and t > was[1]:
                out.append((k, "RD", t - was[1]))
            now[k] = ("run", t)
        else:
            if sleeping and t > was[1]:
                out.append((k, was[0], t - was[1]))
            if not was or sleeping or kind == "new":
                now[k] = ("run", t)
    return sorted(out)


@pytest.mark.parametrize("seed,max_rows", [(1, None), (2, 30)])
def test_task_states(spark, seed, max_rows):
    events = random_events(seed, 500, "iSRXwwn", 8)
    got = sm.task_states(moves(spark, events), max_rows=max_rows)
    assert rows_of(got, "task", "state", "duration") == replay_states(events)


def test_task_states_sleep_only(spark):
    events = [("S", 1, 1), ("w", 4, 1), ("w", 6, 1), ("R", 7, 1), ("S", 8, 1), ("n", 9, 1), ("w", 12, 1)]
    got = sm.task_states(moves(spark, events), only=("S", "D"))
    assert rows_of(got, "state", "duration") == [("S", 3), ("S", 4)]


def test_calls(make):
    events = random_events(3, 400, "eErR", 5)
    functions = {"f": ("e", "r"), "g": ("E", "R")}
    stacks, want = {}, []
    for i, (e, t, k, *_) in enumerate(events):
        open_ = stacks.setdefault((k, e.lower() + e.upper() if False else {"e": "f", "r": "f", "E": "g", "R": "g"}[e]), [])
        if e in "eE":
            open_.append(i)
        elif open_:
            want.append((open_.pop(), i))
    for max_rows in (None, 30):
        calls = ca.call_rows(make(events), functions, max_rows=max_rows)
        assert rows_of(ca.match_calls(calls), "entry_id", "ret_id") == sorted(want)


def nested(seed, n):
    """Properly nested random calls of f, g, h on two threads, plus samples."""
    rng, out, stacks = random.Random(seed), [], {0: [], 1: []}
    truth, samples = {}, {}
    for i in range(n):
        k = 0 if rng.random() < 0.8 else 1
        s = stacks[k]
        x = rng.random()
        if x < 0.15:
            samples[i] = list(s)
            out.append(("sample", i + 1, k))
        elif x < 0.6 or not s:
            f = rng.choice("fgh")
            truth[i] = (s[-1] if s else "root", len(s) + 1, int(f in s))
            s.append(f)
            out.append((f + "_in", i + 1, k))
        else:
            out.append((s.pop() + "_out", i + 1, k))
    return out, truth, samples


@pytest.mark.parametrize("max_rows", [None, 40])
def test_callers_and_frames(make, max_rows):
    events, truth, samples = nested(4, 300)
    functions = {f: (f + "_in", f + "_out") for f in "fgh"}
    calls = ca.call_rows(make(events), functions, max_rows=max_rows)
    got = {r["seq"]: (r["caller"], r["level"], r["recursive"]) for r in ca.callers(calls).collect()}
    assert got == truth
    assert ca.nesting_errors(calls).count() == 0
    frames = ca.open_frames(make(events), functions, ["sample"], max_rows=max_rows)
    assert {r["sample_id"]: r["stack"] for r in frames.collect()} == samples


BIG = 4 * 10**18


def test_call_delay_beyond_bigint(make):
    events = [(e, t, i) for i in range(3) for e, t in (("f_in", i), ("f_out", i + BIG))]
    functions = {"f": ("f_in", "f_out")}
    far = ca.call_delay(ca.call_rows(make(events), functions), wide=None)
    assert rows_of(far, "fn", "calls", "total", "p50", "depth") == [("f", 3, 3 * BIG, BIG, 0)]
    near = ca.call_delay(ca.call_rows(make(events[:2]), functions), wide=None)
    assert near.first()["total"] == BIG and dict(near.dtypes)["total"] == "bigint"


def test_state_stats_beyond_bigint(spark):
    durations = spark.createDataFrame([("S", BIG)] * 3 + [("R", 5)], "state string, duration bigint")
    assert rows_of(sm.state_stats(durations, wide=None), "state", "total", "p99") == [("R", 5, 5), ("S", 3 * BIG, BIG)]
    assert dict(sm.state_stats(durations.where("state = 'R'"), wide=None).dtypes)["total"] == "bigint"


def test_exit_stats_beyond_bigint(spark):
    spans = spark.createDataFrame([(0, 1, 9, BIG)] * 3 + [(0, 1, 1, BIG)], "isa int, reason int, guest_ip bigint, latency bigint")
    row = sm.exit_stats(spans, kernel_start=5, than=7, wide=None).first()
    assert (row["calls"], row["total"], row["avg"], row["gsys_pct"], row["than"]) == (4, 4 * BIG, BIG, 75.0, 4)


def test_exit_spans(spark, make):
    events = random_events(5, 400, "xy", 3)
    open_, want = {}, []
    for i, (e, t, tid, cpu) in enumerate(events):
        if e == "x":
            open_[cpu] = (i, t, tid)
        elif cpu in open_ and open_[cpu][2] == tid and t > open_[cpu][1]:
            want.append((open_[cpu][0], i))
            del open_[cpu]
    df = make(events).withColumns({"isa": F.lit(1), "reason": F.lit(2), "guest_ip": F.lit(-5).cast("bigint")})
    for max_rows in (None, 40):
        spans = sm.exit_spans(df.where("event = 'x'"), df.where("event = 'y'"), max_rows=max_rows)
        assert rows_of(spans, "exit_id", "entry_id") == sorted(want)
    row = sm.exit_stats(spans, kernel_start=-(1 << 31)).first()
    assert row["gsys_pct"] == 100.0 and row["calls"] == len(want)   # -5 is a high unsigned address


def test_io(spark):
    stages = ["get", "insert", "issue", "complete"]
    rng = random.Random(6)
    events = [(rng.choice(stages), t, rng.randrange(3)) for t in range(200)]
    live, want = {}, []
    for e, t, sector in events:
        r = stages.index(e)
        if sector in live:
            want.append((e, t - live[sector][1]))
        if e == "complete":
            live.pop(sector, None)
        else:
            live[sector] = (r, t)
    df = spark.createDataFrame([(e, t, i, 0, s) for i, (e, t, s) in enumerate(events)],
                               "event string, _time bigint, seq bigint, dev int, sector int")
    got = {r["stage"]: (r["reqs"], r["total"]) for r in sm.io_stages(df, stages).collect()}
    assert got == {s: (len(v), sum(v)) for s in stages if (v := [d for e, d in want if e == s])}


def test_leaks(spark):
    rng = random.Random(7)
    events = [(rng.choice("aaf"), t, rng.randrange(20)) for t in range(300)]
    live = {}
    for i, (e, t, p) in enumerate(events):
        live[p] = (p, i) if e == "a" else None
    df = spark.createDataFrame([(e, t, i, p, 10) for i, (e, t, p) in enumerate(events)],
                               "event string, _time bigint, seq bigint, ptr bigint, size bigint")
    a, f = df.where("event = 'a'"), df.where("event = 'f'")
    assert rows_of(lk.leaks(a, f, carry=("size",)), "ptr", "seq") == sorted(v for v in live.values() if v)
    totals = lk.leak_totals(a, f).first()
    assert totals["live"] == sum(v is not None for v in live.values()) and totals["live_bytes"] == 10 * totals["live"]


def test_live_and_ranges(spark):
    df = spark.createDataFrame([("c", 1, 0, 1, 0), ("u", 2, 1, 1, 4), ("d", 3, 2, 1, 0), ("c", 4, 3, 1, 0), ("u", 5, 4, 1, 1),
                                ("u", 6, 5, 1, 2), ("c", 1, 6, 2, 0), ("d", 2, 7, 2, 0)],
                               "event string, _time bigint, seq bigint, id int, bits int")
    got = lk.live_snapshot(df, "id", F.col("event") == "c", F.col("event") == "d", "bits")
    assert rows_of(got) == [(1, 4, 3, 2)]
    r = spark.createDataFrame([(1, 2), (3, 4), (6, 9), (7, 8), (10, 11), (20, 20)], "s int, e int")
    for max_rows in (None, 2):
        assert rows_of(lk.coalesce_ranges(r, "s", "e", max_rows=max_rows), "s", "e") == [(1, 4), (6, 11), (20, 20)]


@pytest.mark.parametrize("max_rows", [None, 25, 60])
def test_hot_seconds(make, max_rows):
    events = random_events(8, 600, "a", 4, span=3000)
    want, state = [], {}
    for i, (_, t, k, *_) in enumerate(events):
        start, n = state.get(k, (None, 0))
        if start is None or t - start >= 100:
            state[k] = (t, 1)
        else:
            state[k] = (start, n + 1)
            if n + 1 >= 5:
                want.append((i, n + 1))
    got = hot_seconds(make(events), freq=10, pct=50, by="_tid", second=100, max_rows=max_rows)
    assert rows_of(got, "seq", "nth") == want


def test_counter_and_quality(make, spark):
    df = make([("a", 1, 1), ("a", 2, 1), ("a", 3, 1)]).withColumn("c", F.expr("element_at(array(10L, 4L, 9L), cast(seq as int) + 1)"))
    assert rows_of(ct.counter_delta(df, "c"), "seq", "delta") == [(0, 10), (1, 0), (2, 5)]
    lost = df.withColumn("n", F.expr("element_at(array(5L, 6L, 9L), cast(seq as int) + 1)"))
    assert rows_of(ct.lost_events(lost, "n"), "seq", "lost") == [(2, 2)]
    late = make([("a", 5, 1), ("a", 3, 1), ("a", 4, 1), ("a", 6, 1)])
    assert rows_of(ct.disorder(late), "seq", "behind") == [(1, 2), (2, 1)]


def test_slots(make):
    df = make([("a", 0, 1), ("a", 1, 1), ("b", 25, 1), ("a", 31, 1)])
    rows = {(r["event"], r["interval"]): r["slots"] for r in ct.count_slots(df, 10, 30).collect()}
    assert rows == {("a", 0): [2, 0, 0], ("b", 0): [0, 0, 1], ("a", 1): [1, 0, 0]}
    far = make([("a", 0, 1), ("b", 99_999, 1)])
    wide = ct.slots_where(far, "a + b = 0", ["a", "b"], 1, by="_tid", fill=True)
    assert rows_of(wide.agg(F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot"))) == [(99_998, 99_998, 1, 99_998)]
    assert rows_of(ct.slots_where(far, "a + b = 0", ["a", "b"], 1, by="_tid", fill="ranges")) == [(1, 1, 99_998, 0, 0)]
    idle = ct.slots_where(df, "a + b = 0", ["a", "b"], 10, fill=True)
    assert rows_of(idle, "slot") == [(1,)]


@pytest.mark.parametrize("max_rows", [None, 40])
def test_callers_with_crossing_returns(make, max_rows):
    events = random_events(9, 300, "eErRe", 3)
    functions = {"f": ("e", "r"), "g": ("E", "R")}
    open_, want = {}, []
    for i, (e, t, k, *_) in enumerate(events):
        stack = open_.setdefault(k, [])
        fn = "f" if e in "er" else "g"
        if e in "eE":
            want.append((i, len(stack) + 1, stack[-1][1] if stack else "root"))
            stack.append((i, fn))
        else:
            mine = [x for x in stack if x[1] == fn]
            if mine:
                stack.remove(mine[-1])
    calls = ca.call_rows(make(events), functions, max_rows=max_rows)
    assert rows_of(ca.callers_any_nesting(calls), "seq", "level", "caller") == want


@pytest.mark.parametrize("max_rows", [None, 30])
def test_merged_io(spark, max_rows):
    stages = ["get", "insert", "issue", "complete"]
    rng = random.Random(10)
    events = [(rng.choice(stages), t, rng.randrange(0, 40, 4), rng.choice([4, 8, 12])) for t in range(250)]
    live, want = [], []
    for e, t, s, n in events:
        met = [x for x in live if x[2] < s + n and s < x[2] + x[3]]
        if met:
            want.append((e, t - max(x[1] for x in met)))
        live = [x for x in live if x not in met]
        if e != "complete":
            live.append((e, t, s, n))
    df = spark.createDataFrame([(e, t, i, 0, s, n) for i, (e, t, s, n) in enumerate(events)],
                               "event string, _time bigint, seq bigint, dev int, sector bigint, nr_sector bigint")
    got = {r["stage"]: (r["reqs"], r["total"]) for r in
           sm.io_stages(df, stages, by=["dev"], merged=True, max_rows=max_rows).collect()}
    assert got == {s: (len(v), sum(v)) for s in stages if (v := [d for e, d in want if e == s])}
