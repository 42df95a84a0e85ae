"""Handlers in the order of a key."""

from __future__ import annotations

import pandas as pd
import pytest
from conftest import random_events, rows_of

from eventframe.sources.handlers import Event, EventHandler, Handler, run_in_order


def test_event_object():
    e = Event({"event": "a", "_time": 3, "k": None})
    assert (e.event, e["_time"], e.get("x", 7), "k" in e, "x" in e, len(e)) == ("a", 3, 7, True, False, 3)
    assert (e.keys(), e.values(), list(e)) == (["event", "_time", "k"], ["a", 3, None], [("event", "a"), ("_time", 3), ("k", None)])
    assert e.items() == list(e) and e.to_dict() == dict(e.items()) and e == Event(e.to_dict()) and hash(e) == hash(Event(e.to_dict()))
    with pytest.raises(AttributeError):
        _ = e.x


def trail():
    class Trail(Handler):      # local, as workers can not import test modules
        """Number and predecessor of each event; one closing row per key with the number of events and of calls to init."""

        def __init__(self):
            self.inits = 0

        def init(self):
            self.inits += 1

        def start(self, key):
            return {"n": 0, "last": -1}

        def rows(self, key, state, events):
            last = events["seq"].shift(fill_value=state["last"])
            out = pd.DataFrame({"key": key[0], "seq": events["seq"], "n": range(state["n"], state["n"] + len(events)), "last": last})
            state.update(n=state["n"] + len(events), last=events["seq"].iloc[-1])
            return out

        def end(self, key, state):
            return pd.DataFrame([{"key": key[0], "seq": -1, "n": state["n"], "last": self.inits}])

    return Trail()


@pytest.mark.parametrize("rows", [0, 40, 3000])
def test_order_and_state_across_batches(spark, make, rows):
    data = random_events(5, rows, "ab", 9)
    df = make(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)      # many batches a key
    try:
        got = rows_of(run_in_order(df, trail(), ["_tid"], "key bigint, seq bigint, n bigint, last bigint"), "key", "seq", "n", "last")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key in {r[2] for r in data}:
        mine = [i for _, i in sorted((r[1], i) for i, r in enumerate(data) if r[2] == key)]
        want += [(key, s, n, mine[n - 1] if n else -1) for n, s in enumerate(mine)] + [(key, -1, len(mine), 1)]
    assert got == sorted(want)


def test_single_events_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 0, None), ("b", 2, 1, None), ("a", 3, 2, 4), ("c", 4, 3, None)], "event string, _time bigint, seq bigint, k bigint")

    def seen(state, e):
        state["n"] = state.get("n", 0) + 1
        return {"event": e.event, "n": state["n"]}

    out = run_in_order(df, EventHandler({"a": seen, "c": seen}), ["k"], "event string, n bigint")
    assert rows_of(out) == [("a", 1), ("a", 1), ("c", 2)]
