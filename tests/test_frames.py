"""Frames by context, process and time, against a plain loop."""

from __future__ import annotations

import random

import pytest

from eventframe.operators.enrich import floor_lookup
from eventframe.operators.frames import KERNEL, KERNEL_DSO, SCRIPT, USER, _mapped, frame_labels, stack_frames

STACK = "id int, _pid bigint, _time bigint, seq bigint, stack array<bigint>"
MAPS = "_pid bigint, _time bigint, seq bigint, start bigint, end bigint, dso string, place bigint"
HIGH = -(1 << 47)       # a kernel address, as a signed number


def world(seed, events):
    rng = random.Random(seed)
    maps = [(rng.randrange(3), rng.randrange(50), i, s := rng.randrange(20) * 50, s + rng.choice([1, 40, 120, 700]),
             rng.choice(["a", "b", "c", None]), rng.randrange(3) * 32) for i in range(60)]
    symbols = sorted({(d, s) for d in "abx" for s in rng.sample(range(900), 15)} | {(KERNEL_DSO, HIGH + s) for s in rng.sample(range(900), 15)})
    symbols = [(d, s, f"{d[0]}{i}", rng.choice([5, 60])) for i, (d, s) in enumerate(symbols)]
    texts = [(i, t) for i, t in enumerate(["main (app.py:3)", "bare", "f (g) (x.py:1)"])]
    rows = []
    for i in range(events):
        stack = [rng.randrange(900)] * rng.randrange(2)
        for context in rng.sample([KERNEL, USER, SCRIPT], rng.randrange(4)):
            low = HIGH if context == KERNEL else 0
            stack += [context, *(rng.randrange(4) if context == SCRIPT else low + rng.randrange(950) for _ in range(rng.randrange(4)))]
        rows.append((i, rng.choice([0, 0, 1, 2, 7, None]), rng.randrange(60), i, rng.choice([stack, stack, stack, stack, None])))
    return rows, symbols, maps, texts


def expected(row, symbols, maps, texts, kernel, user, limited):
    _, pid, t, _, stack = row
    out, context = [], None
    for a in stack or []:
        if a in (KERNEL, USER, SCRIPT):
            context = a
            continue
        if (context == KERNEL and not kernel) or (context in (USER, SCRIPT) and not user):
            continue
        if context is None:
            out.append((a, None, None, None, None))
            continue
        if context == SCRIPT:
            text = dict(texts).get(a)
            name, _, place = (text or "").partition("(")
            out.append((0, "Unknown" if text is None else name[:-1] if place else text, 0, False, place[:-1] if place else None if text is None else ""))
            continue
        dso, place = KERNEL_DSO, a
        if context == USER:
            held = [m for m in maps if m[0] == pid and m[1] <= t and m[3] <= a < m[4]]
            best = max(held, key=lambda m: (m[1], m[2]), default=None)
            dso, place = (best[5], best[6] + a - best[3]) if best and best[5] else (None, None)
        below = max(((s, n, length) for d, s, n, length in symbols if d == dso and s <= place), default=None) if dso else None
        if below and (not limited or place - below[0] < below[2]):
            out.append((a, below[1], place - below[0], context == KERNEL, dso))
        else:
            out.append((a, "Unknown", 0 if context == KERNEL else place or 0, context == KERNEL, KERNEL_DSO if context == KERNEL else "Unknown"))
    return out


@pytest.mark.parametrize(("seed", "events", "kernel", "user", "limited"), [(1, 40, False, True, False), (2, 600, True, True, True), (4, 80, True, False, False)])
def test_stack_frames(spark, seed, events, kernel, user, limited):
    rows, symbols, maps, texts = world(seed, events)
    known = spark.createDataFrame(symbols, "dso string, start bigint, name string, length bigint")
    out = stack_frames(spark.createDataFrame(rows, STACK), known if limited else known.drop("length"), spark.createDataFrame(maps, MAPS),
                       spark.createDataFrame(texts, "addr bigint, text string"), kernel=kernel, user=user)
    assert out.columns == ["id", "_pid", "_time", "seq", "stack", "frames"]
    got = {r["id"]: [tuple(f) for f in r["frames"]] for r in out.collect()}
    assert len(got) == events
    for row in rows:
        want = [(*f[:4], "" if f[0] == 0 and f[1] == "Unknown" and f[4] is None else f[4]) for f in expected(row, symbols, maps, texts, kernel, user, limited)]
        have = [(*f[:4], "" if f[0] == 0 and f[1] == "Unknown" and f[4] is None else f[4]) for f in got[row[0]]]
        assert have == want, row


def test_empty_tables_and_labels(spark):
    none = spark.createDataFrame([], STACK)
    known = spark.createDataFrame([(KERNEL_DSO, HIGH, "entry")], "dso string, start bigint, name string")
    maps = spark.createDataFrame([], MAPS)
    assert stack_frames(none, known, maps).count() == 0
    one = spark.createDataFrame([(1, 5, 1, 1, [7, KERNEL, HIGH + 16, HIGH - 1, USER, 3])], STACK)
    out = stack_frames(one, known, maps).select(frame_labels().alias("x")).first()["x"]
    assert out == ["0x7", "entry+0x10", "Unknown", "Unknown"]


def test_mapped_by_blocks(spark):
    rng = random.Random(5)
    edge = 1 << 62
    spans = [(rng.randrange(2), rng.randrange(40), i, s := rng.choice([-edge, -70, 0, 4096, edge]) + rng.randrange(300),
              s + rng.choice([0, 1, 17, 256, 5000, edge - 400]), rng.choice(["a", "b", None]), i) for i in range(150)]
    asked = sorted({(rng.randrange(3), rng.randrange(40), rng.choice(spans)[rng.choice([3, 4])] + rng.randrange(-2, 3)) for _ in range(200)})
    want = []
    for p, t, a in asked:
        best = max((m for m in spans if m[0] == p and m[1] <= t and m[3] <= a < m[4]), key=lambda m: (m[1], m[2]), default=None)
        if best and best[5]:
            want.append((p, t, a, best[5], best[6] + a - best[3]))
    wanted = spark.createDataFrame(asked, "_pid bigint, _change bigint, addr bigint")
    for max_rows in (None, 30):
        out = _mapped(wanted, spark.createDataFrame(spans, MAPS), "_pid", "_time", max_rows)
        assert sorted(map(tuple, out.collect())) == want


def test_floor_lookup_gathers_no_pages(spark):
    table = spark.createDataFrame([(i * 10, f"s{i}") for i in range(50)], "start bigint, name string")
    out = floor_lookup(spark.createDataFrame([(i,) for i in range(-3, 600, 7)], "addr bigint"), "addr", table)
    assert {r["addr"]: r["name"] for r in out.collect()} == {a: f"s{min(a // 10, 49)}" if a >= 0 else "s49" for a in range(-3, 600, 7)}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
