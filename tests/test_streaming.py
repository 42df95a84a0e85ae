"""Streams in many small deliveries must give the rows of the batch operator."""

from __future__ import annotations

import pytest
from conftest import EVENT_SCHEMA, random_events, rows_of
from pyspark.sql import functions as F

from eventframe.operators import counting as ct
from eventframe.operators import pairs as pr
from eventframe.operators import states as sm
from eventframe.sources.events import stream_events
from eventframe.streaming import incremental as inc
from eventframe.streaming.keyed import stream_pairs_keyed
from test_states import moves

CHAIN = [["a", "b"], ["c"], ["d"]]


def deliver(spark, df, path, parts=3):
    """Deliveries overlap in time: arrival number decides, plus some disorder."""
    n = df.count()
    for i in range(parts):
        part = df.where(f"(seq + seq % 7 * 3) div {n // parts + 1} = {i}")
        part.coalesce(1).write.mode("append").parquet(str(path))
    rest = df.where(f"(seq + seq % 7 * 3) div {n // parts + 1} >= {parts}")
    rest.coalesce(1).write.mode("append").parquet(str(path))
    return stream_events(spark, str(path), df.schema, maxFilesPerTrigger="1")


def test_pairs(spark, make, tmp_path):
    df = make(random_events(1, 240, "abcd", 6))
    stream = deliver(spark, df, tmp_path / "in")
    job = inc.stream_pairs(stream, CHAIN, str(tmp_path / "job"), delay=40)
    job.run().finish(spark)
    cols = ("start_id", "end_id", "latency")
    assert rows_of(job.output(spark), *cols) == rows_of(pr.pair_events(df, CHAIN), *cols)
    assert rows_of(job.open_rows(spark), "seq") == rows_of(pr.unpaired(df, CHAIN), "seq")
    assert job.late_rows(spark).count() == 0


def test_late_rows_are_kept_aside(spark, make, tmp_path):
    df = make([("a", 100, 1), ("c", 200, 1), ("a", 50, 1)])
    path = str(tmp_path / "in")
    for seqs in ("0, 1", "2"):
        df.where(f"seq IN ({seqs})").coalesce(1).write.mode("append").parquet(path)
    stream = stream_events(spark, path, df.schema, maxFilesPerTrigger="1")
    job = inc.stream_pairs(stream, CHAIN[:2], str(tmp_path / "job"), delay=0)
    job.run().finish(spark)
    assert rows_of(job.output(spark), "start_id", "end_id") == [(0, 1)]
    assert rows_of(job.late_rows(spark), "seq") == [(2,)]


def test_resume(spark, make, tmp_path):
    df = make(random_events(2, 120, "abcd", 4))
    path, root = str(tmp_path / "in"), str(tmp_path / "job")
    df.where("seq < 60").coalesce(1).write.parquet(path)
    stream = stream_events(spark, path, df.schema, maxFilesPerTrigger="1")
    inc.stream_pairs(stream, CHAIN, root, delay=10).run()
    df.where("seq >= 60").coalesce(1).write.mode("append").parquet(path)
    again = inc.stream_pairs(stream_events(spark, path, df.schema, maxFilesPerTrigger="1"), CHAIN, root, delay=10)
    again.run().finish(spark)
    cols = ("start_id", "end_id", "latency")
    assert rows_of(again.output(spark), *cols) == rows_of(pr.pair_events(df, CHAIN), *cols)


@pytest.mark.parametrize("seed", [3, 4])
def test_task_states(spark, tmp_path, seed):
    m = moves(spark, random_events(seed, 200, "iSRXwwn", 5))
    stream = deliver(spark, m, tmp_path / "in")
    job = inc.stream_task_states(stream, str(tmp_path / "job"), delay=40).run().finish(spark)
    cols = ("task", "state", "from_time", "duration")
    assert rows_of(job.output(spark), *cols) == rows_of(sm.task_states(m), *cols)


def test_interval_stats(spark, make, tmp_path):
    df = make(random_events(5, 150, "ab", 3)).withColumn("v", F.expr("seq * 3 % 17"))
    df = df.withColumn("_time", F.expr("_time * 1000000"))
    stream = deliver(spark, df, tmp_path / "in")
    got = inc.stream_interval_stats(stream, 25_000_000, "v", str(tmp_path / "job"), "1 hour")
    cols = ("interval", "event", "n", "total", "min", "max")
    assert rows_of(got, *cols) == rows_of(ct.interval_stats(df, 25_000_000, "v"), *cols)
    assert EVENT_SCHEMA


def expired_of(rows, names, life):
    """Starts whose next event on their key, or the end of the stream, is more than ``life`` later: (seq)."""
    by_key = {}
    for seq, (event, t, key, _) in enumerate(rows):
        if event in "abcd":
            by_key.setdefault(key, []).append((t, seq, event))
    end = max(t for event, t, *_ in rows)
    out = []
    for events in by_key.values():
        events.sort()
        for (t, seq, event), after in zip(events, [*events[1:], None]):
            if event in names and (after[0] if after else end) - t > life:
                out.append((seq,))
    return sorted(out)


@pytest.mark.parametrize("n, life", [(240, 60), (2_400, 300)])
def test_keyed_state_expires(spark, make, tmp_path, n, life):
    rows = random_events(n, n, "abcd", 40, hot=0.1)
    df = make(rows)
    job = stream_pairs_keyed(deliver(spark, df, tmp_path / "in", 4), CHAIN, str(tmp_path / "job"), delay=n // 6, expire=life, compact=2)
    job.run().finish(spark)
    cols = ("start_id", "end_id", "latency")
    assert rows_of(job.output(spark), *cols) == rows_of(pr.pair_events(df, CHAIN).where(f"latency <= {life}"), *cols)
    assert job.late_rows(spark).count() == 0
    assert rows_of(job.expired(spark), "seq") == expired_of(rows, "abc", life)
    open_ = {r[0] for r in rows_of(pr.unpaired(df, CHAIN), "seq")}
    assert {r[0] for r in rows_of(job.open_rows(spark), "seq")} == open_ - {r[0] for r in rows_of(job.expired(spark), "seq")}


def test_writes_follow_the_touched_keys(spark, make, tmp_path):
    df = make([("a", i, i) for i in range(500)] + [("c", 1_000, 7), ("a", 1_001, 501)])
    path = str(tmp_path / "in")
    df.where("seq < 500").coalesce(1).write.parquet(path)
    df.where("seq >= 500").coalesce(1).write.mode("append").parquet(path)
    job = stream_pairs_keyed(stream_events(spark, path, df.schema, maxFilesPerTrigger="1"), CHAIN[:2], str(tmp_path / "job"), delay=0)
    job.run()
    counts = {(part, b): spark.read.parquet(f"{job.root}/{part}/batch={b}").count() for part in ("delta", "held", "out") for b in (0, 1)}
    assert counts == {("delta", 0): 500, ("held", 0): 0, ("out", 0): 0, ("delta", 1): 2, ("held", 1): 0, ("out", 1): 1}
    assert job.open_rows(spark).count() == 500


@pytest.mark.parametrize("when", ["before", "between", "after", "twice"])
def test_losses_in_any_order(spark, make, tmp_path, when):
    df = make(random_events(9, 300, "abcd", 5, span=3_000))
    times = {r[0] for r in df.select("_time").collect()}
    free = [t for t in range(100, 2_900, 97) if t not in times]
    ranges = spark.createDataFrame([(t, t + 60) for t in free[::3]], "start_time bigint, end_time bigint")
    path = tmp_path / "in"
    job = stream_pairs_keyed(deliver(spark, df, path), CHAIN, str(tmp_path / "job"), delay=500, compact=2)
    if when in ("before", "twice"):
        job.lose(ranges, 0)
    if when == "between":
        job.lose(ranges.where("start_time % 2 = 0"), 0)
    job.run()
    if when == "between":
        job.lose(ranges.where("start_time % 2 = 1"), 1)
    job.finish(spark)
    if when in ("after", "twice"):
        job.lose(ranges, 0)
    cols = ("start_id", "end_id", "latency")
    want = rows_of(pr.pair_events(df, CHAIN, lost=ranges), *cols)
    assert rows_of(job.output(spark), *cols) == want
    if when == "after":
        assert job.retracted(spark).count() == pr.pair_events(df, CHAIN).count() - len(want)
