"""The batch operators on a stream: micro-batches with carried-over rows.

Each micro-batch is held back until the stream's newest event is ``delay`` ahead (that merges the many unordered
buffers), then the batch operator runs over the ready rows plus the few rows earlier batches left open - at most one
per key. So streams use the same JVM-side, skew-safe plans as tables and give the same rows.

State (open rows, rows held back, the horizon) is written per batch to a folder all executors reach. A batch reads
only the state of its predecessor and overwrites its own output, so a retried batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pairs as pr
from ..operators import states as sm
from ..operators.timeline import prev, timeline
from ..schema import ORDER, as_column

MOVE_COLUMNS = ["task", "kind", "state", "_time", "seq"]

Step = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class Incremental:
    """Run ``step(rows) -> (output, open rows)`` over a stream; ``root`` holds output, state and checkpoint."""

    stream: DataFrame
    step: Step
    root: str
    delay: int
    final: int = field(default=-1, init=False)

    def _path(self, part: str, batch: int) -> str:
        return f"{self.root}/{part}/batch={batch}"

    def _load(self, part: str, batch: int, like: DataFrame) -> DataFrame | None:
        if batch < 0:
            return None
        return like.sparkSession.read.schema(like.schema).parquet(self._path(part, batch))

    def _horizon(self, spark, batch: int) -> int | None:
        if batch < 0:
            return None
        return spark.read.parquet(self._path("horizon", batch)).first()[0]

    def _advance(self, new: DataFrame, batch: int, flush: bool = False) -> None:
        spark = new.sparkSession
        passed = self._horizon(spark, batch - 1)
        held = self._load("held", batch - 1, new)
        opened = self._load("open", batch - 1, new)
        new = new.persist()
        late = F.lit(False) if passed is None else F.col("_time") <= passed
        newest, too_late = new.agg(F.max("_time"), F.count_if(late)).first()
        horizon = passed
        if newest is not None:
            horizon = newest - self.delay if passed is None else max(passed, newest - self.delay)
        rows = new.where(~late) if too_late else new
        if held is not None:
            rows = rows.unionByName(held)
        ready = F.lit(True) if flush else F.col("_time") <= (horizon if horizon is not None else 0)
        work = rows.where(ready)
        if opened is not None:
            work = work.unionByName(opened)
        output, still_open = self.step(work)
        output.write.mode("overwrite").parquet(self._path("out", batch))
        still_open.select(*new.columns).write.mode("overwrite").parquet(self._path("open", batch))
        rows.where(~ready).write.mode("overwrite").parquet(self._path("held", batch))
        if too_late or self.final < 0:
            # Rows behind the horizon can no longer be put in order; they are kept aside, not dropped.
            new.where(late).write.mode("overwrite").parquet(self._path("late", batch))
        spark.range(1).select(F.lit(horizon).cast("bigint").alias("horizon")).write.mode("overwrite").parquet(
            self._path("horizon", batch))
        new.unpersist()
        self.final = batch

    def start(self, **trigger) -> StreamingQuery:
        """The running query; the trigger is Spark's (``processingTime="1 minute"``, ``availableNow=True``), by default batch after batch."""
        writer = self.stream.writeStream.foreachBatch(self._advance).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def run(self) -> Incremental:
        """Process what the source holds now; call again to continue."""
        self.start(availableNow=True).awaitTermination()
        return self

    def finish(self, spark) -> Incremental:
        """End of stream: process the rows still held back."""
        if self.final < 0:   # resumed without new data: continue after the last saved batch
            self.final = spark.read.parquet(f"{self.root}/horizon").agg(F.max("batch")).first()[0]
        empty = spark.createDataFrame([], self.stream.schema)
        self._advance(empty, self.final + 1, flush=True)
        return self

    def output(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.root}/out").drop("batch")

    def open_rows(self, spark) -> DataFrame:
        """What is still open after the last batch: unpaired starts, current states, live allocations."""
        return spark.read.parquet(self._path("open", self.final))

    def late_rows(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.root}/late").drop("batch")


def _newest(rows: DataFrame, keys: Sequence[str | Column], keep: Column, columns: Sequence[str]) -> DataFrame:
    """The newest row of each key, where ``keep`` holds for it."""
    best = rows.groupBy(*[as_column(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(F.struct(*columns, keep.alias("_keep")), F.struct(*ORDER)).alias("r"))
    return best.where("r._keep").select("r.*").drop("_keep")


def stream_pairs(stream: DataFrame, levels: Sequence[Sequence[str]], root: str, delay: int,
                 key: str | Column | Mapping = "_tid", **options) -> Incremental:
    """Pairs of :func:`pair_events` over a stream. Starts stay open across batches."""
    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        marked = pr.roles(rows, levels, key, options.get("role"), options.get("cycle", False),
                          options.get("name", "event"), options.get("untraced", ()), options.get("reclaim", ()))
        return pr.pair_events(rows, levels, key, **options), _newest(marked, ["key"], F.col("_starts"), rows.columns)
    return Incremental(stream, step, root, delay)


def stream_task_states(stream: DataFrame, root: str, delay: int) -> Incremental:
    """Durations of :func:`task_states` over a stream of task moves (task, kind, state, _time, seq)."""
    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        # The newest move that had an effect is the task's state; dead tasks leave nothing behind.
        effective = sm.effective_moves(rows)
        return sm.spent(effective), _newest(effective.rows(), ["task"], ~F.col("_dies"), MOVE_COLUMNS)
    return Incremental(stream, step, root, delay)


def stream_leaks(stream: DataFrame, alloc: str | Column, root: str, delay: int, ptr: str = "ptr",
                 carry: Sequence[str] = ("size",)) -> Incremental:
    """Live allocations over a stream of alloc and free events; read them with ``open_rows``.

    The output holds the matched frees: ptr, alloc and free ids, lifetime.
    """
    is_alloc = as_column(alloc)

    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        flagged = rows.withColumn("_alloc", is_alloc)
        tl = timeline(flagged, ptr).scan(_p=prev("_alloc", "_time", "seq"))
        done = tl.rows().where(~F.col("_alloc") & F.col("_p._alloc")).select(
            ptr, F.col("_p.seq").alias("alloc_id"), F.col("seq").alias("free_id"),
            (F.col("_time") - F.col("_p._time")).alias("lifetime"))
        return done, _newest(flagged, [ptr], F.col("_alloc"), rows.columns)
    return Incremental(stream, step, root, delay)


def stream_interval_stats(stream: DataFrame, interval: int, value: str | Column, root: str, delay: str,
                          by: Sequence[str] = ("event",)) -> DataFrame:
    """n, total, min, max per tumbling report interval, with watermark; the latest version of every window is read back.

    Runs until the source is drained and returns the rows of :func:`interval_stats`.
    """
    v = as_column(value)
    spark = stream.sparkSession
    stamped = stream.withColumn("_ts", F.timestamp_micros(F.expr("_time div 1000"))).withWatermark("_ts", delay)
    stats = stamped.groupBy(F.window("_ts", f"{interval // 1000} microseconds").alias("w"), *by).agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    (stats.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    versions = spark.read.parquet(f"{root}/out")
    latest = versions.groupBy("w", *by).agg(F.max_by(F.struct("n", "total", "min", "max"), "batch").alias("r"))
    return latest.select(F.expr(f"(unix_micros(w.start) * 1000) div {interval}L").alias("interval"), *by, "r.*")

