"""Reading, writing, hooks and comparison."""

from __future__ import annotations

import pytest
from conftest import random_events, rows_of

from eventframe.shared import SETTING, shared_dir
from eventframe.sources import events as src


def test_write_and_read(spark, make, tmp_path):
    df = make(random_events(1, 200, "abc", 5))
    path = str(tmp_path / "events")
    src.write_events(df, path, interval=50, key="_tid")
    back = src.read_events(spark, path)
    assert rows_of(back, *df.columns) == rows_of(df)
    one = src.read_events(spark, path, event="a")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event" in plan
    assert one.count() == df.where("event = 'a'").count()


def test_hooks(spark, make, tmp_path):
    df = make(random_events(2, 60, "ab", 3))
    path = str(tmp_path / "in")
    for i in range(2):
        df.where(f"seq % 2 = {i}").coalesce(1).write.mode("append").parquet(path)
    seen = []
    stream = src.stream_events(spark, path, df.schema, maxFilesPerTrigger="1")
    src.for_each_interval(stream, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c")).awaitTermination()
    assert seen == [(0, 30), (1, 30)]
    lost = spark.createDataFrame([(1, 5), (7, 9)], "start_time bigint, end_time bigint")
    spans = src.on_lost(lost, lambda r: (r["end_time"] - r["start_time"]).to_frame("span"), "span bigint")
    assert rows_of(spans) == [(2,), (4,)]
    got = src.run_handlers(df, {"a": lambda r: r[["seq"]]}, "seq bigint")
    assert got.count() == df.where("event = 'a'").count()


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "i int, s string")
    assert rows_of(src.compare_results(a, b)) == [("left", 1, "x", 1), ("right", 3, "z", 1)]
    assert src.compare_results(a, a).count() == 0
    with pytest.raises(ValueError):
        src.compare_results(a, b.withColumnRenamed("s", "t"))


def test_alias_select_instances(make):
    df = make([("sched:a", 1, 1, 0), ("sched:b", 2, 2, 1), ("irq:c", 3, 3, 2)])
    assert rows_of(src.select_events(df, "sched:*"), "seq") == [(0,), (1,)]
    assert rows_of(src.select_events(df, "irq:c,*:a"), "seq") == [(0,), (2,)]
    assert rows_of(src.alias_events(df, {"x": "seq < 2", "y": "seq > 0"}), "alias", "seq") == [
        ("x", 0), ("x", 1), ("y", 1), ("y", 2)]
    assert rows_of(src.on_instances(df, cpus="0,2", tids="2-3"), "seq") == [(2,)]
    assert rows_of(src.since(df, 2), "seq") == [(1,), (2,)]
    assert rows_of(src.take_events(df, 2), "seq") == [(0,), (1,)]


def test_clock(spark):
    df = spark.createDataFrame([(1 << 61,), (5,)], "_time bigint")
    assert rows_of(src.shift_clock(df, 7, mult=1000, shift=10)) == [(4 + 7,), ((1 << 61) * 1000 // 1024 + 7,)]


class Session:
    """Stands in for a session with or without the cluster's setting."""

    def __init__(self, value):
        self.conf = {SETTING: value} if value else {}


def test_shared_dir_reads_the_cluster_setting():
    assert shared_dir(Session("hdfs://nn/scratch/"), "x").startswith("hdfs://nn/scratch/x-")
    a, b = (shared_dir(Session(None), "x") for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_tables_and_batches(spark, make):
    src.register_tables(make([("a", 1, 1), ("b", 2, 1), ("b", 3, 1)]))
    got = src.run_batch(spark, "SELECT count(*) FROM a; SELECT count(*) FROM b;")
    assert [g.first()[0] for g in got] == [1, 2]


def test_statements_with_semicolons_inside(spark):
    from eventframe.sources.events import run_batch
    a, b = run_batch(spark, "SELECT 'a;b' AS x -- one; two\n; /* c;d */ SELECT 'it\\';s' AS `y;z`; -- end;\n")
    assert a.first()[0] == "a;b" and b.first()[0] == "it';s" and b.columns == ["y;z"]


def test_shared_folder_needs_setting_off_one_machine():
    from types import SimpleNamespace

    import pytest

    from eventframe.shared import shared_dir
    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf), "x")


def test_top_keeps_user_keys(spark):
    from eventframe.operators.counting import top
    df = spark.createDataFrame([(-1, 1), (-1, 2), (5, 3), (None, 4)], "ret int, _tid int")
    assert {r["key"]: r["n"] for r in top(df, key="ret", add={"n": "1"}).collect()} == {-1: 2, 5: 1, None: 1}
