"""Keyed stream state that is written as it changes, expires, and takes losses that arrive late.

What a batch writes follows what it touches: the rows that arrived and must wait, the keys whose open row changed (a key
that closed leaves a tombstone), and its results. Every ``compact`` batches the changes are merged into a new base; a batch reads
the last base and the changes after it, for the keys it touches only. An open start lives for ``expire``: an end that comes
later does not pair, and a start that nothing took leaves at the next compaction; both are kept in ``expired`` with the reason.

Ranges in which events were lost may arrive at any time. They are kept by arrival; pairs that reach into a known range are not
emitted, pairs that were emitted before are retracted: ``retracted`` names them, ``output`` leaves them out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as pr
from ..operators.rangejoin import overlap_join
from ..schema import ORDER
from .incremental import Incremental

# rows -> (output, expired rows, newest row of every key: _key, _keep and the row's columns)
KeyedStep = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]
META = "horizon bigint, base int, held array<struct<batch: int, newest: bigint>>"


@dataclass
class Keyed(Incremental):
    """Run a keyed step over a stream. ``key_of`` adds the ``_key`` of a row; ``losses`` is whether pairs reach into lost ranges."""

    key_of: Callable[[DataFrame], DataFrame] = None
    expire: int | None = None
    compact: int = 8

    def _meta(self, spark: SparkSession, batch: int) -> tuple[int | None, int, list[tuple[int, int]]]:
        """Horizon, batch of the last base and the batches that may still hold waiting rows, after ``batch``."""
        if batch < 0:
            return None, -1, []
        row = spark.read.schema(META).parquet(self._path("meta", batch)).first()
        return row["horizon"], row["base"], [(h["batch"], h["newest"]) for h in row["held"]]

    def _state(self, spark: SparkSession, base: int, batch: int, schema, touched: DataFrame | None = None) -> DataFrame | None:
        """The open rows after ``batch``, of the touched keys or of all."""
        paths = ([self._path("base", base)] if base >= 0 else []) + [self._path("delta", b) for b in range(base + 1, batch + 1)]
        parts = [spark.read.schema(schema).parquet(p).withColumn("_version", F.lit(i)) for i, p in enumerate(paths)]
        if not parts:
            return None
        versions = parts[0]
        for p in parts[1:]:
            versions = versions.unionByName(p)
        if touched is not None:
            versions = versions.join(touched, "_key", "left_semi")
        newest = versions.groupBy("_key").agg(F.max_by(F.struct(*[c for c in versions.columns if c not in ("_key", "_version")]), "_version").alias("r"))
        return newest.select("_key", "r.*").where("_keep")

    def _advance(self, new: DataFrame, batch: int, flush: bool = False) -> None:
        spark = new.sparkSession
        passed, base, waiting = self._meta(spark, batch - 1)
        new = new.persist()
        late = F.lit(False) if passed is None else F.col("_time") <= passed
        newest, too_late = new.agg(F.max("_time"), F.count_if(late)).first()
        horizon = passed if newest is None else newest - self.delay if passed is None else max(passed, newest - self.delay)
        if flush:
            horizon = max([t for t in (passed, *(n for _, n in waiting)) if t is not None], default=None)
        rows = new.where(~late)
        ready = F.lit(horizon is not None) & (F.col("_time") <= F.lit(horizon).cast("bigint"))
        work = rows.where(ready)
        for b, n in waiting:     # written once, on arrival; read when they are due
            if n > (passed if passed is not None else n - 1):
                due = spark.read.schema(new.schema).parquet(self._path("held", b)).where(ready)
                work = work.unionByName(due if passed is None else due.where(F.col("_time") > passed))
        work = self.key_of(work).persist()
        schema = work.withColumn("_keep", F.lit(True)).schema
        known = self._state(spark, base, batch - 1, schema, work.select("_key").distinct())
        full = work if known is None else work.unionByName(known.drop("_keep"))
        output, expired, newest_rows = self.step(full)
        self._emit(output, batch)
        expired.write.mode("overwrite").parquet(self._path("expired", batch))
        delta = newest_rows.select(*[f.name for f in schema])
        delta.write.mode("overwrite").parquet(self._path("delta", batch))
        stays = rows.where(~ready)
        stays.write.mode("overwrite").parquet(self._path("held", batch))
        held = [(b, n) for b, n in waiting if horizon is None or n > horizon]
        if newest is not None and (horizon is None or newest > horizon):
            held.append((batch, newest))
        if batch - base >= self.compact or flush:
            self._compacted(spark, base, batch, schema, horizon)
            base = batch
        if too_late or self.final < 0:
            new.where(late).write.mode("overwrite").parquet(self._path("late", batch))
        spark.createDataFrame([(horizon, base, held)], META).write.mode("overwrite").parquet(self._path("meta", batch))
        work.unpersist()
        new.unpersist()
        self.final = batch

    def _compacted(self, spark: SparkSession, base: int, batch: int, schema, horizon: int | None) -> None:
        """Merge the changes into a new base; starts whose time is over leave it."""
        state = self._state(spark, base, batch, schema)
        over = F.lit(False)
        if self.expire is not None and horizon is not None:
            over = F.col("_time") < horizon - self.expire
        state.where(~over).write.mode("overwrite").parquet(self._path("base", batch))
        gone = state.where(over).drop("_keep", "_key").withColumn("reason", F.lit("age"))
        gone.write.mode("overwrite").parquet(self._path("expired_open", batch))

    def _lost(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.root}/lost")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":    # no range has arrived yet
                return None
            raise

    def _emit(self, output: DataFrame, batch: int) -> None:
        lost = self._lost(output.sparkSession)
        if lost is not None:
            output = output.join(_reaching(output, lost), "end_id", "left_anti")
        output.write.mode("overwrite").parquet(self._path("out", batch))

    def lose(self, ranges: DataFrame, arrival: int) -> None:
        """Take (start_time, end_time) ranges that became known; ``arrival`` numbers their deliveries, a repeated one changes nothing."""
        spark = ranges.sparkSession
        kept = f"{self.root}/lost/arrival={arrival}"
        ranges.select("start_time", "end_time").write.mode("overwrite").parquet(kept)
        if self.final >= 0:
            emitted = spark.read.parquet(f"{self.root}/out").drop("batch")
            _reaching(emitted, spark.read.parquet(kept)).withColumn("version", F.lit(self.final)).write.mode("overwrite").parquet(
                f"{self.root}/retracted/arrival={arrival}")

    def retracted(self, spark: SparkSession) -> DataFrame:
        """end_id of the pairs taken back, and the last batch that had still counted them (version)."""
        return spark.read.parquet(f"{self.root}/retracted").groupBy("end_id").agg(F.min("version").alias("version"))

    def output(self, spark: SparkSession) -> DataFrame:
        out = spark.read.parquet(f"{self.root}/out").drop("batch")
        lost = self._lost(spark)
        return out if lost is None else out.join(_reaching(out, lost), "end_id", "left_anti")

    def expired(self, spark: SparkSession) -> DataFrame:
        parts = [spark.read.parquet(f"{self.root}/expired").drop("batch")]
        if self.expire is not None:
            parts.append(spark.read.parquet(f"{self.root}/expired_open").drop("batch"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def open_rows(self, spark: SparkSession) -> DataFrame:
        _, base, _ = self._meta(spark, self.final)
        schema = spark.read.parquet(self._path("delta", self.final)).schema
        return self._state(spark, base, self.final, schema).drop("_key", "_keep")

    def finish(self, spark: SparkSession) -> Keyed:
        if self.final < 0:
            self.final = spark.read.parquet(f"{self.root}/meta").agg(F.max("batch")).first()[0]
        self._advance(spark.createDataFrame([], self.stream.schema), self.final + 1, flush=True)
        return self


def _reaching(pairs: DataFrame, lost: DataFrame) -> DataFrame:
    """end_id of the pairs with a lost range between or around their ends; one may end where a range begins."""
    spans = pairs.select("end_id", F.col("start_time").alias("_a"), F.col("end_time").alias("_b"))
    ranges = lost.select(F.col("start_time").alias("_c"), F.col("end_time").alias("_d"))
    return overlap_join(spans, ranges, ("_a", "_b"), ("_c", "_d")).select("end_id").distinct()


def stream_pairs_keyed(stream: DataFrame, levels: Sequence[Sequence[str]], root: str, delay: int, key: str | Column | Mapping = "_tid",
                       expire: int | None = None, compact: int = 8, **options) -> Keyed:
    """Pairs of :func:`pair_events` over a stream, with state by key.

    With ``expire`` only pairs of at most this latency are made, and older starts leave with the reason ``age``. Ranges of lost
    events are given to ``lose``, before or after the events they concern; they affect all instances. (Of events exactly at a
    range's start that share their time with another of their key, the batch operator may pair one anew; this does not.)
    """
    name = options.get("name", "event")

    def key_of(rows: DataFrame) -> DataFrame:
        marked = pr.roles(rows, levels, key, options.get("role"), options.get("cycle", False), name, options.get("untraced", ()), options.get("reclaim", ()))
        return marked.select(*rows.columns, F.col("key").cast("string").alias("_key"))

    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        plain = [c for c in rows.columns if c != "_key"]
        marked = pr.roles(rows, levels, key, options.get("role"), options.get("cycle", False), name, options.get("untraced", ()), options.get("reclaim", ()))
        newest = marked.groupBy("_key").agg(F.max_by(F.struct(*plain, F.col("_starts").alias("_keep")), F.struct(*ORDER)).alias("r")).select("_key", "r.*")
        pairs = pr.pair_events(rows, levels, key, **options)
        if expire is None:
            return pairs, rows.select(*plain).withColumn("reason", F.lit("age")).limit(0), newest
        carried = pr.pair_timeline(rows, levels, key, carry=[c for c in plain if c not in (name, "seq", "_time", "_cpu", "_tid")],
                                   **{k: v for k, v in options.items() if k != "carry"}).rows()
        over = carried.where(F.col("_prev._starts") & (F.col("_time") - F.col("_prev._time") > expire))
        return pairs.where(F.col("latency") <= expire), over.select(*[F.col(f"_prev.{c}").alias(c) for c in plain], F.lit("age").alias("reason")), newest

    return Keyed(stream, step, root, delay, key_of=key_of, expire=expire, compact=compact)
