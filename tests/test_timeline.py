"""Chunked scans of hot keys must equal plain windows."""

from __future__ import annotations

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from eventframe.operators.timeline import last, position, prev, run_max, run_min, run_sum, timeline

def scans():
    return dict(p=prev("seq", "v"), l=last("maybe"), s=run_sum("v"), lo=run_min("v"), hi=run_max("v"))


def table(spark, n=600):
    rng = random.Random(5)
    data = [(None if rng.random() < 0.1 else 0 if rng.random() < 0.6 else rng.randrange(9), rng.randrange(n // 3), i,
             rng.randrange(-50, 50), rng.randrange(9) if rng.random() < 0.3 else None) for i in range(n)]
    return spark.createDataFrame(data, "key int, _time bigint, seq bigint, v bigint, maybe int")


@pytest.mark.parametrize("key", [["key"], []])
@pytest.mark.parametrize("max_rows", [7, 40])
def test_chunks_equal_windows(spark, key, max_rows):
    df = table(spark)
    plain = timeline(df, key)
    cut = timeline(df, key, max_rows=max_rows)
    assert not plain.cut and cut.cut
    cols = ["seq", "p.seq", "p.v", "l", "s", "lo", "hi"]
    pick = [F.col(c).alias(c.replace(".", "_")) for c in cols]
    assert rows_of(plain.scan(**scans()).rows().select(*pick)) == rows_of(cut.scan(**scans()).rows().select(*pick))


def test_chunks_are_small(spark):
    cut = timeline(table(spark), "key", max_rows=20)
    sizes = [r["count"] for r in cut.frame.groupBy("key", "_chunk").count().collect()]
    assert max(sizes) <= 60


def test_filtered_and_rekeyed(spark):
    df = table(spark).withColumn("sub", F.expr("v % 3"))

    def run(tl):
        tl = tl.scan(s=run_sum("v")).map(lambda f: f.where("v % 2 = 0")).rekey("sub").scan(p=prev("s"))
        return rows_of(tl.rows().select("seq", "s", F.col("p.s").alias("ps")))
    assert run(timeline(df, "key")) == run(timeline(df, "key", max_rows=15))


def test_position(spark):
    df = spark.range(12).select(F.array(*[F.lit(x) for x in (2, 2, 5, 9)]).alias("a"), "id")
    got = [r[0] for r in df.select(position("a", F.col("id"), 4)).collect()]
    assert got == [sum(v <= i for v in (2, 2, 5, 9)) for i in range(12)]


def test_cut_plan_has_no_unbounded_window(spark):
    cut = timeline(table(spark), "key", max_rows=20).scan(s=run_sum("v"))
    plan = cut.rows()._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
