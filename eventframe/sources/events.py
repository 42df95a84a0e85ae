"""Reading, combining, restricting and writing event frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import glob, in_cpulist
from ..schema import ORDER, any_of, as_column, per_event

# Functions available on payload columns in SQL, by column type.
FUNCTIONS_BY_TYPE = {
    "bigint": "symbolic,ksymbol,syscall",
    "int": "symbolic,syscall",
    "binary": "ipv4_str,ipv4_hstr,ipv6_str,ipsa_str,ipsa_hstr,uuid_str,guid_str,mac_str",
}


def read_events(spark: SparkSession, path: str, event: str | None = None, fmt: str = "parquet",
                schema: T.StructType | None = None) -> DataFrame:
    """One event type (or all) as a table. ``event`` becomes a partition or row-group filter."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df if event is None else df.where(F.col("event") == event)


def union_events(*frames: DataFrame) -> DataFrame:
    """Several event types as one stream; missing payload columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def alias_events(df: DataFrame, aliases: Mapping[str, str | Column]) -> DataFrame:
    """The same rows under several names with their own filters; one pass over the input."""
    named = [F.when(as_column(cond), F.lit(name)) for name, cond in aliases.items()]
    return df.withColumn("alias", F.explode(F.array_compact(F.array(*named))))


def select_events(df: DataFrame, pattern: str, name: str = "event") -> DataFrame:
    """Event types matching a name, a glob, or a comma-separated list of them."""
    parts = [p.strip() for p in pattern.split(",")]
    plain = [p for p in parts if not set(p) & set("*?[")]
    conds = [glob(name, p) for p in parts if set(p) & set("*?[")]
    if plain:
        conds.append(F.col(name).isin(plain))
    return df.where(any_of(conds))


def on_instances(df: DataFrame, cpus: str | None = None, pids: str | None = None, tids: str | None = None,
                 groups: list[str] | None = None, group_column: str = "cgroup") -> DataFrame:
    """Restrict to cpu, pid or tid lists (``"0-3,7"``) or control groups."""
    for column, wanted in (("_cpu", cpus), ("_pid", pids), ("_tid", tids)):
        if wanted is not None:
            df = df.where(in_cpulist(column, wanted))
    return df if groups is None else df.where(F.col(group_column).isin(groups))


def per_event_cpus(df: DataFrame, cpus: Mapping[str, str]) -> DataFrame:
    """Cpu list per event type; types not named are kept everywhere."""
    return df.where(per_event({e: in_cpulist("_cpu", c) for e, c in cpus.items()}, default=F.lit(True)))


def take_events(df: DataFrame, n: int) -> DataFrame:
    """The first n events in time order (a top-k, not a global sort)."""
    return df.orderBy(*ORDER).limit(n)


def since(df: DataFrame, start: int) -> DataFrame:
    """Drop events recorded before the enable time."""
    return df.where(F.col("_time") >= start)


def write_events(df: DataFrame, path: str, interval: int | None = None, key: str | None = None) -> None:
    """Persist events partitioned by type (and interval number), sorted by key and time inside files.

    The rebalance lets AQE size the files: a type with most of the rows is split over many tasks, rare ones share one.
    """
    parts = ["event"]
    if interval:
        df = df.withColumn("interval", F.expr(f"_time div {interval}L"))
        parts.append("interval")
    order = parts + [c for c in (key, *ORDER) if c]
    balanced = df.hint("rebalance", *[F.col(p) for p in parts]).sortWithinPartitions(*order)
    balanced.write.mode("errorifexists").partitionBy(*parts).parquet(path)


def stream_events(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  **options: str) -> DataFrame:
    """A recorded stream (files; any Spark streaming source by ``fmt``) as a streaming events frame."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def publish_events(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **options: str):
    """Write a streaming events frame to files (or any streaming sink); returns the query."""
    return (df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
            .options(**options).trigger(availableNow=True).start())


def shift_clock(df: DataFrame, offset: int | str | Column = 0, mult: int = 1, shift: int = 0) -> DataFrame:
    """``((t * mult) >> shift) + offset``; the product is taken in DECIMAL, so it cannot overflow."""
    t = F.col("_time")
    if mult != 1 or shift:
        wide = t.cast("decimal(19,0)") * F.lit(mult).cast("decimal(19,0)")
        t = F.floor(wide / F.lit(2 ** shift).cast("decimal(19,0)")).cast("bigint") if shift else wide.cast("bigint")
    off = F.lit(offset) if isinstance(offset, int) else as_column(offset)
    return df.withColumn("_time", t + off)


def to_wall(df: DataFrame, base_event: int | str | Column, base_wall: int | str | Column) -> DataFrame:
    """Wall-clock ns: ``base_wall + (t - base_event)``."""
    be, bw = (F.lit(x) if isinstance(x, int) else as_column(x) for x in (base_event, base_wall))
    return df.withColumn("wall_ns", bw + (F.col("_time") - be))


def map_instances(df: DataFrame, mapping: DataFrame, on: str, columns: Mapping[str, str]) -> DataFrame:
    """Rewrite instance columns through a small mapping table; unknown instances become -1."""
    side = mapping.select(F.col(on), *[F.col(src).alias(f"__m_{dst}") for dst, src in columns.items()])
    out = df.join(side, on, "left")
    out = out.withColumns({dst: F.coalesce(F.col(f"__m_{dst}"), F.lit(-1)) for dst in columns})
    return out.drop(*[f"__m_{dst}" for dst in columns])


def event_metadata(df: DataFrame, system: str = "events") -> DataFrame:
    """Per event type: field count, sample count, first and last time, usable functions."""
    fields = [f for f in df.schema.fields if not f.name.startswith("_") and f.name not in ("event", "seq")]
    functions = {f for t in (x.dataType.simpleString() for x in fields)
                 for f in FUNCTIONS_BY_TYPE.get(t, "").split(",") if f}
    return (
        df.groupBy("event")
        .agg(F.count("*").alias("sample_count"), F.min("_time").alias("first_sample_time"),
             F.max("_time").alias("last_sample_time"))
        .select(
            F.col("event").alias("table_name"), F.lit(system).alias("event_system"),
            F.col("event").alias("event_name"), F.lit(len(fields)).alias("field_count"), "sample_count",
            "first_sample_time", "last_sample_time", F.lit(",".join(sorted(functions))).alias("function_list"),
        )
    )


def event_rates(df: DataFrame) -> DataFrame:
    """Duration and events per second of every event type."""
    span = (F.col("last_sample_time") - F.col("first_sample_time")) / F.lit(1e9)
    return event_metadata(df).select(
        "table_name", span.alias("duration_sec"),
        F.try_divide(F.col("sample_count").cast("double"), span).alias("rate_per_sec"),
    )


def rate_guard(df: DataFrame, by: str, limit: float, interval: int) -> DataFrame:
    """Events per second of every instance in each interval, flagged over the limit."""
    n = F.col("n")
    return (
        df.groupBy(F.col(by).alias("inst"), F.expr(f"_time div {interval}").alias("interval"))
        .agg(F.count("*").alias("n"))
        .withColumn("per_sec", n * F.lit(1_000_000_000) / F.lit(interval))
        .withColumn("over_limit", (F.col("per_sec") > limit).cast("int"))
    )


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with multiplicity; raises when column names or types differ."""
    sa, sb = ([(f.name, f.dataType.simpleString()) for f in d.schema.fields] for d in (a, b))
    if sa != sb:
        raise ValueError(f"schemas differ: {sa} / {sb}")
    cols = a.columns
    # One shuffle for both directions: count with opposite signs instead of two EXCEPT ALLs.
    signed = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1)))
    diff = signed.groupBy(*cols).agg(F.sum("__d").alias("__d")).where("__d <> 0")
    return diff.select(F.when(F.col("__d") > 0, "left").otherwise("right").alias("side"), *cols,
                       F.abs("__d").alias("copies"))


def split_statements(text: str) -> list[str]:
    """The statements between semicolons that stand outside of literals, quoted names and comments."""
    quoted = r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|`[^`]*+`|--[^\n]*+|/\*.*?\*/"
    parts, last = [], 0
    for m in re.finditer(quoted + "|;", text, re.S):
        if m.group() == ";":
            parts.append(text[last:m.start()])
            last = m.end()
    parts.append(text[last:])
    return [p for p in parts if re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip()]


def run_batch(spark: SparkSession, statements: str | list[str]) -> list[DataFrame]:
    """Several SQL statements over the same registered event tables."""
    if isinstance(statements, str):
        statements = split_statements(statements)
    return [spark.sql(s) for s in statements]


def register_tables(df: DataFrame, name: str = "event",
                    aliases: Mapping[str, str | Column] | None = None) -> list[str]:
    """A temp view per event type (the listing is bounded by the number of types) or per alias."""
    if aliases:
        for alias, cond in aliases.items():
            df.where(as_column(cond)).createOrReplaceTempView(alias)
        return list(aliases)
    types = [r[0] for r in df.select(name).distinct().collect()]
    for t in types:
        df.where(F.col(name) == t).createOrReplaceTempView(t.replace(":", "_"))
    return types


def run_handlers(df: DataFrame, handlers: Mapping[str, Callable], schema: str | T.StructType,
                 name: str = "event") -> DataFrame:
    """Call ``handlers[event](pandas_frame) -> pandas_frame`` on Arrow batches of each event type.

    Handlers see one batch at a time; they must not rely on batches holding whole groups.
    """
    wanted = df.where(F.col(name).isin(list(handlers)))

    def apply(batches):
        for batch in batches:
            for event, rows in batch.groupby(name, sort=False):
                out = handlers[event](rows.reset_index(drop=True))
                if out is not None and len(out):
                    yield out

    return wanted.mapInPandas(apply, schema)


def for_each_interval(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Call ``handler(events, number)`` on every report interval (micro-batch) of a stream; returns the query."""
    return (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def on_lost(lost: DataFrame, handler: Callable, schema: str | T.StructType) -> DataFrame:
    """Call ``handler(pandas_frame) -> pandas_frame`` on Arrow batches of lost ranges (start_time, end_time, ...)."""
    def apply(batches):
        for batch in batches:
            yield handler(batch)
    return lost.mapInPandas(apply, schema)
