"""Sources, sinks, metadata and clocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import events as src
from ..sources.handlers import EventHandler, Handler, run_in_order
from .registry import DAY, E, EPOCH_2024, HOUR, META, events, query, table


@query("src_event_table", E + " SELECT seq, _time, _cpu, _pid, _tid, num, k FROM e WHERE event = 'view'")
def src_event_table(spark, sf):
    return events(spark, sf).where("event = 'view'").select("seq", "_time", "_cpu", "_pid", "_tid", "num", "k")


@query("src_union_events", E + """
SELECT event, seq, _time, k, NULL::BIGINT AS num FROM e WHERE event = 'click'
UNION ALL SELECT event, seq, _time, NULL::INT, num FROM e WHERE event = 'purchase'""")
def src_union_events(spark, sf):
    e = events(spark, sf)
    clicks = e.where("event = 'click'").select("event", "seq", "_time", "k")
    buys = e.where("event = 'purchase'").select("event", "seq", "_time", "num")
    return src.union_events(clicks, buys)


@query("src_alias_split", E + """
SELECT 'small' AS alias, seq, k FROM e WHERE event = 'view' AND k < 50
UNION ALL SELECT 'rich', seq, k FROM e WHERE event = 'view' AND num > 5000""")
def src_alias_split(spark, sf):
    views = events(spark, sf).where("event = 'view'")
    return src.alias_events(views, {"small": "k < 50", "rich": "num > 5000"}).select("alias", "seq", "k")


@query("src_event_glob", E + """
SELECT event, count(*) AS n FROM e WHERE event GLOB 'p*' OR event GLOB '[cv]*' OR event = 'error' GROUP BY event""")
def src_event_glob(spark, sf):
    return src.select_events(events(spark, sf), "p*,[cv]*,error").groupBy("event").agg(F.count("*").alias("n"))


@query("flt_instances", E + """
SELECT seq, _cpu, _pid FROM e WHERE (_cpu BETWEEN 0 AND 2 OR _cpu = 5) AND _pid BETWEEN 10 AND 90""")
def flt_instances(spark, sf):
    return src.on_instances(events(spark, sf), cpus="0-2,5", pids="10-90").select("seq", "_cpu", "_pid")


@query("flt_event_cpus", E + """
SELECT seq, event, _cpu FROM e WHERE CASE event WHEN 'view' THEN _cpu BETWEEN 0 AND 3
  WHEN 'click' THEN _cpu = 7 ELSE true END""")
def flt_event_cpus(spark, sf):
    return src.per_event_cpus(events(spark, sf), {"view": "0-3", "click": "7"}).select("seq", "event", "_cpu")


@query("snk_roundtrip", E + f" SELECT event, _time, seq, _cpu, num, k, _time // {DAY} AS day FROM e")
def snk_roundtrip(spark, sf):
    path = shared_dir(spark, "roundtrip")
    src.write_events(events(spark, sf), path, interval=DAY, key="_cpu")
    return src.read_events(spark, path).select(
        "event", "_time", "seq", "_cpu", "num", "k", F.col("interval").cast("bigint").alias("day"))


@query("stm_file_source", E + " SELECT event, seq, _time, num FROM e WHERE k >= 10")
def stm_file_source(spark, sf):
    raw = table(spark, sf, "events")
    stream = src.stream_events(spark, sf, raw.schema, pathGlobFilter="events.parquet")
    rows = stream.where(F.get_json_object("props", "$.k").cast("int") >= 10).select(
        "event_id", "ts", "event_type", "value")
    out = shared_dir(spark, "published")
    src.publish_events(rows, out, shared_dir(spark, "published-state")).awaitTermination()
    from ..schema import epoch_ns
    return spark.read.schema(rows.schema).parquet(out).select(
        F.col("event_type").alias("event"), F.col("event_id").alias("seq"), epoch_ns("ts").alias("_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("num"))


@query("meta_event_table", META + " SELECT * FROM m")
def meta_event_table(spark, sf):
    return src.event_metadata(events(spark, sf))


@query("meta_event_rate", META + """
SELECT table_name, (last_sample_time - first_sample_time) / 1e9::DOUBLE AS duration_sec,
  sample_count::DOUBLE / ((last_sample_time - first_sample_time) / 1e9::DOUBLE) AS rate_per_sec FROM m""")
def meta_event_rate(spark, sf):
    return src.event_rates(events(spark, sf))


@query("lim_first_n", E + " SELECT seq, _time, event FROM e ORDER BY _time, seq LIMIT 100")
def lim_first_n(spark, sf):
    return src.take_events(events(spark, sf), 100).select("seq", "_time", "event")


@query("rate_guard", E + f"""
SELECT _cpu AS inst, _time // {HOUR} AS interval, count(*) AS n, count(*) * 1000000000 / {HOUR} AS per_sec,
  CAST(count(*) * 1000000000 / {HOUR} > 0.001 AS INT) AS over_limit FROM e GROUP BY ALL""")
def rate_guard(spark, sf):
    return src.rate_guard(events(spark, sf), "_cpu", 0.001, HOUR)


@query("clk_offset", E + """
SELECT seq, CAST(floor(CAST(_time AS HUGEINT) * 3 / 4) AS BIGINT) + 250 AS _time FROM (
  SELECT seq, _time // 1024 AS _time FROM e)""")
def clk_offset(spark, sf):
    ticks = events(spark, sf).select("seq", F.expr("_time div 1024").alias("_time"))
    return src.shift_clock(ticks, offset=250, mult=3, shift=2)


@query("clk_wall", E + f" SELECT seq, {EPOCH_2024} + (_time - 5000) AS wall_ns FROM e")
def clk_wall(spark, sf):
    return src.to_wall(events(spark, sf), 5000, EPOCH_2024).select("seq", "wall_ns")


@query("map_instances", E + """
SELECT seq, CAST(coalesce(CASE WHEN n_nationkey IS NOT NULL THEN n_nationkey % 4 END, -1) AS BIGINT) AS _cpu,
  CAST(coalesce(n_nationkey * 100, -1) AS BIGINT) AS _tid
FROM e LEFT JOIN nation ON n_nationkey = _pid""")
def map_instances(spark, sf):
    vcpus = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("_pid"), (F.col("n_nationkey") % 4).cast("bigint").alias("host_cpu"),
        (F.col("n_nationkey") * 100).cast("bigint").alias("host_tid"))
    return src.map_instances(events(spark, sf), vcpus, "_pid", {"_cpu": "host_cpu", "_tid": "host_tid"}).select(
        "seq", "_cpu", "_tid")


@query("cmp_results", E + """
, a AS (SELECT event, _cpu, count(*) AS n FROM e GROUP BY ALL),
b AS (SELECT event, _cpu, count(*) AS n FROM e WHERE k <> 7 GROUP BY ALL)
SELECT 'left' AS side, event, _cpu, n, 1::BIGINT AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT 'right', event, _cpu, n, 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def cmp_results(spark, sf):
    def count(df):
        return df.groupBy("event", "_cpu").agg(F.count("*").alias("n"))
    e = events(spark, sf)
    return src.compare_results(count(e), count(e.where("k <> 7")))


@query("sql_multi", E + """
SELECT 'by_event' AS statement, event AS name, count(*) AS n FROM e GROUP BY event
UNION ALL SELECT 'by_cpu', CAST(_cpu AS VARCHAR), count(*) FROM e GROUP BY _cpu""")
def sql_multi(spark, sf):
    events(spark, sf).createOrReplaceTempView("multi_events")
    a, b = src.run_batch(spark, """
        SELECT 'by_event' AS statement, event AS name, count(*) AS n FROM multi_events GROUP BY event;
        SELECT 'by_cpu' AS statement, cast(_cpu AS string) AS name, count(*) AS n FROM multi_events GROUP BY _cpu""")
    return a.union(b)


HANDLED = "event string, seq bigint, score bigint"


def _double(rows):
    return rows.assign(score=rows["num"] * 2)[["event", "seq", "score"]]


def _minus_k(rows):
    return rows.assign(score=rows["num"] - rows["k"])[["event", "seq", "score"]]


@query("usr_handlers", E + """
SELECT event, seq, CASE event WHEN 'view' THEN num * 2 ELSE num - k END AS score FROM e
WHERE event IN ('view', 'click')""")
def usr_handlers(spark, sf):
    return src.run_handlers(events(spark, sf), {"view": _double, "click": _minus_k}, HANDLED)


def _count(state, event):
    state["n"] = state.get("n", 0) + 1
    state["last"] = event.seq


def _buy(state, event):
    out = {"_pid": event._pid, "seq": event["seq"], "since": state.get("n", 0), "before": state.get("last", -1)}
    state["n"] = 0
    return out


@query("usr_ordered", E + """
, g AS (SELECT *, count(*) FILTER (event = 'purchase') OVER w - CASE WHEN event = 'purchase' THEN 1 ELSE 0 END AS lap FROM e
  WINDOW w AS (PARTITION BY _pid ORDER BY _time, seq))
SELECT _pid, seq, n AS since, coalesce(last, -1) AS before FROM (SELECT _pid, seq, event,
    count(*) FILTER (event <> 'purchase') OVER (PARTITION BY _pid, lap) AS n,
    last_value(CASE WHEN event <> 'purchase' THEN seq END IGNORE NULLS) OVER (PARTITION BY _pid ORDER BY _time, seq) AS last FROM g)
WHERE event = 'purchase'""")
def usr_ordered(spark, sf):
    """Events of a user since the last purchase, counted by handlers in order."""
    handlers = EventHandler({"purchase": _buy}, default=_count)
    return run_in_order(events(spark, sf), handlers, ["_pid"], "_pid bigint, seq bigint, since bigint, before bigint")


class _Pace(Handler):
    """Longest pause of a key, over its whole life."""

    def start(self, key):
        return {"at": None, "pause": 0, "n": 0}

    def rows(self, key, state, events):
        times = events["_time"]
        pauses = times.diff().fillna(0)
        if state["at"] is not None:
            pauses.iloc[0] = times.iloc[0] - state["at"]
        state.update(at=int(times.iloc[-1]), pause=max(state["pause"], int(times.diff().max() if len(times) > 1 else 0), int(pauses.iloc[0])),
                     n=state["n"] + len(events))

    def end(self, key, state):
        return pd.DataFrame([{"_cpu": key[0], "n": state["n"], "pause": state["pause"]}])


@query("usr_key_end", E + """
SELECT _cpu, count(*) AS n, CAST(max(pause) AS BIGINT) AS pause FROM (SELECT _cpu,
  coalesce(_time - lag(_time) OVER (PARTITION BY _cpu ORDER BY _time, seq), 0) AS pause FROM e) GROUP BY _cpu""")
def usr_key_end(spark, sf):
    return run_in_order(events(spark, sf), _Pace(), ["_cpu"], "_cpu int, n bigint, pause bigint")
