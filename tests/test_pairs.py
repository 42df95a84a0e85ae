"""Pairing against a replay of its rules on random event lists."""

from __future__ import annotations

import pytest
from conftest import random_events, rows_of
from pyspark.sql import functions as F

from eventframe.operators import pairs as pr
from eventframe.operators import stats as st

CHAIN = [["a", "b"], ["c"], ["d"]]


def replay(events, levels, cycle=False, role=None, lost=()):
    """One open start per key; enders take it, starters replace it."""
    level = {e: i for i, names in enumerate(levels) for e in names}
    held, out = {}, []
    for seq, (event, t, key, *_) in enumerate(events):
        for a, b in lost:
            if t > a:
                held = {k: v for k, v in held.items() if v[1] >= b or v[1] < 0} if t >= b else held
        if event not in level:
            continue
        lv, bits = level[event], role(seq) if role else 3
        ends = bool(bits & 2) and (cycle or lv != 0)
        starts = bool(bits & 1) and (cycle or lv != len(levels) - 1)
        if any(a < t < b for a, b in lost):
            continue
        passed = sum(b <= t for _, b in lost)
        if any(a == t for a, _ in lost):
            starts = False
        slot = (key, passed)
        if ends and slot in held:
            plv, pt, pseq = held.pop(slot)
            hop = (plv + 1) % len(levels) if cycle else plv + 1
            if hop == lv and pt < t:
                out.append((pseq, seq, t - pt))
        if starts:
            held[slot] = (lv, t, seq)
    return sorted(out), sorted(v[2] for v in held.values())


@pytest.mark.parametrize("seed,max_rows", [(1, None), (2, 25), (3, 60)])
def test_chain_and_cycle(make, seed, max_rows):
    events = random_events(seed, 500, "abcdx", 12)
    for cycle in (False, True):
        pairs, still_open = replay(events, CHAIN, cycle)
        got = pr.pair_events(make(events), CHAIN, cycle=cycle, max_rows=max_rows)
        assert rows_of(got, "start_id", "end_id", "latency") == pairs
        assert [r[0] for r in rows_of(pr.unpaired(make(events), CHAIN, cycle=cycle), "seq")] == still_open


def test_single_level_cycle(make):
    events = random_events(4, 200, "a", 5)
    pairs, _ = replay(events, [["a"]], cycle=True)
    assert rows_of(pr.pair_events(make(events), [["a"]], cycle=True), "start_id", "end_id", "latency") == pairs


def test_roles(make):
    events = random_events(6, 300, "abc", 4)
    pairs, _ = replay(events, [["a", "b"], ["c"]], cycle=True, role=lambda i: i % 4)
    got = pr.pair_events(make(events), [["a", "b"], ["c"]], cycle=True, role="seq % 4")
    assert rows_of(got, "start_id", "end_id", "latency") == pairs


@pytest.mark.parametrize("literal", [1000, 0])
def test_lost_ranges(spark, make, monkeypatch, literal):
    monkeypatch.setattr(pr, "LITERAL_RANGES", literal)
    events = random_events(7, 400, "abcd", 6)
    lost = [(20, 45), (100, 101), (events[200][1], events[200][1] + 30), (380, 395)]
    pairs, _ = replay(events, CHAIN, lost=lost)
    ranges = spark.createDataFrame(lost, "start_time bigint, end_time bigint")
    got = pr.pair_events(make(events), CHAIN, lost=ranges, max_rows=40)
    assert rows_of(got, "start_id", "end_id", "latency") == pairs


def test_lost_ranges_of_one_instance(spark, make):
    events = [("a", 1, 5, 0), ("a", 2, 6, 1), ("c", 9, 5, 0), ("c", 9, 6, 1)]
    lost = spark.createDataFrame([(3, 5, 0)], "start_time bigint, end_time bigint, _cpu int")
    got = pr.pair_events(make(events), [["a"], ["c"]], lost=lost, lost_by="_cpu")
    assert rows_of(got, "start_id", "end_id") == [(1, 3)]


def test_edges(make):
    two = [["a"], ["c"]]
    # Only the later start pairs; an end without start and a start without end stay alone.
    assert rows_of(pr.pair_events(make([("a", 1, 1), ("a", 2, 1), ("c", 3, 1), ("c", 4, 1), ("a", 5, 1)]), two),
                   "start_id", "end_id") == [(1, 2)]
    # Equal times: no pair, but the start is taken.
    assert rows_of(pr.pair_events(make([("a", 1, 1), ("c", 1, 1), ("c", 2, 1)]), two)) == []
    # An end that skips a level takes the start without a pair.
    assert rows_of(pr.pair_events(make([("a", 1, 1), ("d", 2, 1), ("c", 3, 1)]), CHAIN)) == []
    with pytest.raises(ValueError):
        pr.pair_events(make([("a", 1, 1)]), [["a"], ["c"]], untraced=["c"])


def test_orphans(make):
    events = [("a", 1, 1), ("a", 2, 1), ("c", 3, 1), ("c", 4, 1), ("a", 5, 1)]
    got = pr.unpaired(make(events), [["a"], ["c"]], report_orphans=True)
    assert rows_of(got, "seq", "reason") == [(0, "overwritten"), (3, "end"), (4, "open")]


@pytest.mark.parametrize("literal", [1000, 2])
def test_epochs(make, monkeypatch, literal):
    monkeypatch.setattr(pr, "LITERAL_RANGES", literal)
    events = random_events(8, 200, "abcx", 3)
    seen, want = 0, []
    for i, e in enumerate(events):
        seen += e[0] == "x"
        want.append((i, seen))
    assert rows_of(pr.epochs(make(events), "event = 'x'", max_rows=30), "seq", "epoch") == want


def test_only_than_is_all_or_nothing(make):
    p = pr.pair_events(make([("a", 1, 1), ("c", 4, 1), ("b", 5, 1), ("c", 6, 1)]), [["a", "b"], ["c"]])
    assert st.delay_stats(p, than=2, only_than=True).count() == 2
    assert st.delay_stats(p, than=3, only_than=True).count() == 0


def test_delay_stats_match_sorted_values(make):
    events = random_events(9, 800, "ac", 3, span=100_000)
    lat = sorted(x[2] for x in replay(events, [["a"], ["c"]])[0])
    row = st.delay_stats(pr.pair_events(make(events), [["a"], ["c"]]), than=lat[-3]).first()
    at = lambda p: lat[max(-(-len(lat) * p // 100), 1) - 1]
    assert (row["calls"], row["total"], row["min"], row["max"]) == (len(lat), sum(lat), lat[0], lat[-1])
    assert (row["p50"], row["p95"], row["p99"], row["than"]) == (at(50), at(95), at(99), sum(v > lat[-3] for v in lat))
    rough = st.delay_stats(pr.pair_events(make(events), [["a"], ["c"]]), exact=False, wide=True).first()
    assert rough["p50"] == row["p50"] and int(rough["total"]) == row["total"]


@pytest.mark.parametrize("extra", [{}, {"than": 7, "only_than": True}, {"sort": True}])
def test_delay_stats_beyond_bigint(make, extra):
    events = [(e, t, i) for i in range(3) for e, t in (("a", i), ("c", i + 4 * 10**18))] + [("b", 1, 9), ("d", 3, 9)]
    p = pr.pair_events(make(events), [["a", "b"], ["c", "d"]])
    assert rows_of(st.delay_stats(p, wide=None, **extra), "start", "total") == [("a", 12 * 10**18), ("b", 2)]
    if "than" not in extra:
        assert dict(st.delay_stats(p.where("start = 'b'"), wide=None, **extra).dtypes)["total"] == "bigint"


def test_rundelay_and_wakeups(spark):
    switches = spark.createDataFrame(
        [(10, 0, 1, 0, 7), (20, 2, 7, 1, 8), (30, 3, 8, 0, 7)],
        "_time bigint, seq bigint, prev_pid bigint, prev_state int, next_pid bigint").withColumns(
        {"_cpu": F.lit(0), "_tid": F.col("prev_pid")})
    wakes = spark.createDataFrame([("sched_wakeup", 15, 1, 8)], "event string, _time bigint, seq bigint, pid bigint"
                                  ).withColumns({"_cpu": F.lit(1), "_tid": F.lit(3).cast("bigint")})
    # 8: woken at 15, runs at 20; 7 left asleep (state 1) so its switch-in at 30 has no start; 1 was preempted at 10.
    assert rows_of(pr.rundelay(switches, wakes), "key", "start", "latency") == [(8, "sched_wakeup", 5)]


def test_reclaim(make):
    events = [("a", 1, 1), ("x", 2, 1), ("c", 3, 1), ("a", 4, 1), ("c", 5, 1), ("a", 6, 2), ("x", 7, 2)]
    two = [["a"], ["c"]]
    assert rows_of(pr.pair_events(make(events), two, reclaim=["x"]), "start_id", "end_id") == [(3, 4)]
    assert rows_of(pr.unpaired(make(events), two, reclaim=["x"])) == []
