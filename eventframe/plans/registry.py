"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import epoch_ns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table in canonical columns."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("event"), epoch_ns("ts").alias("_time"), F.col("event_id").alias("seq"),
        (F.col("user_id") % 8).cast("int").alias("_cpu"), F.col("user_id").alias("_pid"),
        F.col("user_id").alias("_tid"), F.round(F.col("value") * 100).cast("bigint").alias("num"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


# The same mapping for the oracle; every event query starts from it.
E = """WITH e AS (SELECT event_type AS event, epoch_us(ts) * 1000 AS _time, event_id AS seq,
  CAST(user_id % 8 AS INT) AS _cpu, user_id AS _pid, user_id AS _tid,
  CAST(round(value * 100) AS BIGINT) AS num, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""

HOUR = 3_600_000_000_000
DAY = 24 * HOUR
EPOCH_2024 = 1_704_067_200_000_000_000   # 2024-01-01 UTC in ns

META = E + """, m AS (SELECT event AS table_name, 'events' AS event_system, event AS event_name, 2 AS field_count,
  count(*) AS sample_count, min(_time) AS first_sample_time, max(_time) AS last_sample_time,
  'ksymbol,symbolic,syscall' AS function_list FROM e GROUP BY event)"""
