"""Counting, slots, counters, ratios, gaps, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counting as ct
from ..operators.hotspots import hot_seconds
from ..operators.stats import bitfield_dist, num_dist
from .registry import DAY, E, HOUR, events, query

TYPES = ["view", "click", "purchase", "signup", "error"]
COUNTS = ", ".join(f"count(*) FILTER (event = '{t}') AS {t}" for t in TYPES)


@query("top_keys", E + """
SELECT _tid AS key, CAST(sum(num) AS BIGINT) AS total, count(*) AS n, min('u' || _pid) AS name FROM e
WHERE _tid <> -1 GROUP BY _tid ORDER BY total DESC, n DESC, key LIMIT 50""")
def top_keys(spark, sf):
    return ct.top(events(spark, sf), by={"total": "num"}, add={"n": "1"}, name="concat('u', _pid)", n=50)


@query("top_matrix", E + f" SELECT _tid AS key, {COUNTS} FROM e GROUP BY _tid")
def top_matrix(spark, sf):
    return ct.event_matrix(events(spark, sf), "_tid", TYPES)


@query("top_comm", E + """
SELECT 'u' || k % 20 AS name, CAST(sum(CASE WHEN event = 'view' THEN num ELSE 0 END) AS BIGINT) AS seen,
  CAST(sum(CASE WHEN event = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM e GROUP BY 1""")
def top_comm(spark, sf):
    return ct.top(events(spark, sf), by={"seen": "if(event = 'view', num, 0)"},
                  add={"clicks": "if(event = 'click', 1, 0)"}, name="concat('u', k % 20)", only_name=True)


@query("num_dist", E + """
SELECT event, _cpu, count(*) AS calls, CAST(sum(num) AS BIGINT) AS total, min(num) AS min,
  CAST(sum(num) AS BIGINT) // count(*) AS avg, CAST(quantile_disc(num, 0.99) AS BIGINT) AS p99, max(num) AS max,
  count(*) FILTER (num > 5000) AS than FROM e GROUP BY event, _cpu""")
def num_dist_query(spark, sf):
    return num_dist(events(spark, sf), "num", by=["_cpu"], than=5000)


CELLS = E + f""", c AS (SELECT _cpu AS inst, event, _time // {DAY} AS interval, CAST(_time % {DAY} // {HOUR} AS INT) AS slot,
  count(*) AS n FROM e GROUP BY ALL)"""


@query("count_slots", CELLS + """
, g AS (SELECT DISTINCT inst, event, interval FROM c)
SELECT g.inst, g.event, g.interval, string_agg(coalesce(n, 0), ',' ORDER BY s.slot) AS slots,
  CAST(sum(coalesce(n, 0)) AS BIGINT) AS sum, max(n) AS max
FROM g CROSS JOIN (SELECT unnest(range(24)) AS slot) s LEFT JOIN c ON c.inst = g.inst AND c.event = g.event
  AND c.interval = g.interval AND c.slot = s.slot GROUP BY ALL""")
def count_slots(spark, sf):
    return ct.count_slots(events(spark, sf), HOUR, DAY).withColumn(
        "slots", F.array_join(F.col("slots").cast("array<string>"), ","))


@query("count_burst", CELLS + """
SELECT inst, event, CAST(sum(n) AS BIGINT) AS total, max(n) AS burst FROM c GROUP BY inst, event""")
def count_burst(spark, sf):
    return ct.slot_counts(events(spark, sf), HOUR, DAY).groupBy("inst", "event").agg(
        F.sum("n").alias("total"), F.max("n").alias("burst"))


@query("count_pivot", E + f"""
SELECT _time // {DAY} AS interval, _cpu AS inst, count(*) FILTER (event = 'view') AS view,
  CASE WHEN _cpu < 4 THEN count(*) FILTER (event = 'click') END AS click FROM e GROUP BY interval, inst, _cpu""")
def count_pivot(spark, sf):
    return ct.count_pivot(events(spark, sf), DAY, {"view": None, "click": "inst < 4"})


# A counter per CPU that often falls: only its rises count.
COUNTER = E + """
, c AS (SELECT *, num * 10 + k AS counter FROM e WHERE event IN ('view', 'signup')),
d AS (SELECT *, greatest(counter - coalesce(lag(counter) OVER (PARTITION BY _cpu ORDER BY _time, seq), 0), 0) AS delta FROM c)"""


def counters(spark, sf):
    rows = events(spark, sf).where("event IN ('view', 'signup')").withColumn("counter", F.expr("num * 10 + k"))
    return ct.counter_delta(rows, "counter")


@query("counter_delta", COUNTER + " SELECT _cpu, seq, counter, delta FROM d")
def counter_delta(spark, sf):
    return counters(spark, sf).select("_cpu", "seq", "counter", "delta")


@query("percpu_counts", E + """
SELECT cpu, view, click, error // 2 AS error FROM (
  SELECT CAST(_cpu AS VARCHAR) AS cpu, count(*) FILTER (event = 'view') AS view, count(*) FILTER (event = 'click') AS click,
    count(*) FILTER (event = 'error') AS error FROM e GROUP BY _cpu
  UNION ALL SELECT 'ALL', count(*) FILTER (event = 'view'), count(*) FILTER (event = 'click'),
    count(*) FILTER (event = 'error') FROM e)""")
def percpu_counts(spark, sf):
    return ct.preset_counts(events(spark, sf), ["view", "click", "error"], halved=["error"])


@query("ratio_ipc", COUNTER + """
SELECT _cpu, coalesce(CAST(sum(delta) AS DOUBLE) / nullif(sum(k), 0), 0) AS ratio FROM d GROUP BY _cpu""")
def ratio_ipc(spark, sf):
    return ct.ratio(counters(spark, sf), "delta", "k", ["_cpu"])


@query("ratio_hit", E + """
SELECT _cpu, event, CASE WHEN sum(num) > sum(k * 50) THEN CAST(sum(num) - sum(k * 50) AS DOUBLE) / sum(num) ELSE 0 END
  AS ratio FROM e GROUP BY ALL""")
def ratio_hit(spark, sf):
    rows = events(spark, sf).withColumn("misses", F.expr("cast(k as bigint) * 50"))
    return ct.hit_ratio(rows, "num", "misses", ["_cpu", "event"])


@query("ratio_util", COUNTER + f"""
SELECT _cpu, _time // {DAY} AS interval, CAST(sum(delta) AS DOUBLE) * 100.0 / 86400000.0 AS util FROM d GROUP BY ALL""")
def ratio_util(spark, sf):
    rows = counters(spark, sf).withColumn("interval", F.expr(f"_time div {DAY}L"))
    return ct.cpu_util(rows, "delta", khz=1, interval_ms=86_400_000, by=["_cpu", "interval"])


@query("ip_histogram", E + """
SELECT event AS mode, num // 100 AS ip, count(*) AS n FROM e GROUP BY ALL""")
def ip_histogram(spark, sf):
    return ct.ip_histogram(events(spark, sf).withColumn("ip", F.expr("num div 100")), mode="event", sort=True)


# Level and snoop fields of the test's data source word.
LEVELS = {0: "L1", 1: "L2", 2: "L3", 3: "RAM"}
SNOOPS = {0: "None", 1: "Hit", 2: "HitM"}


@query("bitfield_dist", E + """
SELECT label, count(*) AS samples, CAST(sum(num) AS BIGINT) AS total, min(num) AS min, max(num) AS max,
  CAST(sum(num) AS BIGINT) // count(*) AS avg, count(*) FILTER (num > 3000) AS than FROM (SELECT num,
    CASE k & 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' WHEN 2 THEN 'L3' ELSE 'RAM' END || ' '
    || CASE (k >> 4) & 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Hit' WHEN 2 THEN 'HitM' ELSE 'N/A' END AS label FROM e)
GROUP BY label""")
def bitfields(spark, sf):
    return bitfield_dist(events(spark, sf), "k", {"level": (0, 2, LEVELS), "snoop": (4, 2, SNOOPS)}, "num", than=3000)


SLOTS = E + f""", s AS (SELECT _cpu AS inst, _time // {HOUR} AS slot, count(*) FILTER (event = 'view') AS view,
  count(*) FILTER (event = 'click') AS click FROM e GROUP BY ALL)"""


@query("slot_condition", SLOTS + " SELECT * FROM s WHERE view > click AND click = 0")
def slot_condition(spark, sf):
    return ct.slots_where(events(spark, sf), "view > click AND click = 0", ["view", "click"], HOUR)


@query("slot_condition_idle", SLOTS + """
, b AS (SELECT inst, min(slot) AS lo, max(slot) AS hi FROM s GROUP BY inst),
f AS (SELECT inst, x AS slot FROM b, unnest(range(lo, hi + 1)) AS u(x))
SELECT f.inst, f.slot, coalesce(view, 0) AS view, coalesce(click, 0) AS click FROM f LEFT JOIN s USING (inst, slot)
WHERE coalesce(view, 0) + coalesce(click, 0) = 0""")
def slot_condition_idle(spark, sf):
    return ct.slots_where(events(spark, sf), "view + click = 0", ["view", "click"], HOUR, fill=True)


@query("slot_condition_wide", E + """
, c AS (SELECT _cpu AS inst, _time // 1000 AS slot, count(*) FILTER (event = 'view') AS view,
    count(*) FILTER (event = 'click') AS click FROM e GROUP BY ALL),
g AS (SELECT inst, lag(slot) OVER (PARTITION BY inst ORDER BY slot) + 1 AS lo, slot - 1 AS hi FROM c)
SELECT inst, slot, slot AS last, view, click FROM c WHERE view + click = 0
UNION ALL SELECT inst, lo, hi, 0, 0 FROM g WHERE lo <= hi""")
def slot_condition_wide(spark, sf):
    return ct.slots_where(events(spark, sf), "view + click = 0", ["view", "click"], 1000, fill="ranges")


@query("gap_detect", E + f"""
SELECT * FROM (SELECT _cpu AS inst, lag(seq) OVER w AS from_id, seq AS to_id, lag(_time) OVER w AS from_time,
  _time AS to_time, _time - lag(_time) OVER w AS gap FROM e WINDOW w AS (PARTITION BY _cpu ORDER BY _time, seq))
WHERE gap > {2 * HOUR}""")
def gap_detect(spark, sf):
    return ct.gaps(events(spark, sf), than=2 * HOUR)


@query("heartbeat_missing", E + f"""
SELECT inst, check_id, check_time, age FROM (SELECT c._cpu AS inst, c.seq AS check_id, c._time AS check_time,
  c._time - b._time AS age FROM (SELECT * FROM e WHERE event = 'error') c
  ASOF JOIN (SELECT * FROM e WHERE event = 'view') b ON b._cpu = c._cpu AND b._time <= c._time) WHERE age > {6 * HOUR}""")
def heartbeat_missing(spark, sf):
    e = events(spark, sf)
    return ct.missing_heartbeat(e.where("event = 'view'"), e.where("event = 'error'"), limit=6 * HOUR)


@query("quality_lost", E + """
, c AS (SELECT *, lag(seq + 1) OVER (PARTITION BY event, _cpu ORDER BY _time, seq) AS before FROM e)
SELECT event, _cpu, seq, _time, seq + 1 - before - 1 AS lost FROM c WHERE before <> 0 AND seq + 1 - before <> 1""")
def quality_lost(spark, sf):
    rows = events(spark, sf).withColumn("counter", F.expr("seq + 1"))
    return ct.lost_events(rows, "counter")


# Delivery order differs from time order: the arrival number is time plus a delay of up to two hours.
@query("quality_disorder", E + f"""
, a AS (SELECT *, _time + num % 7200 * 1000000000 AS arrival FROM e),
b AS (SELECT *, max(_time) OVER (PARTITION BY _cpu ORDER BY arrival, seq ROWS UNBOUNDED PRECEDING) AS newest FROM a)
SELECT _cpu AS inst, arrival AS seq, _time, newest - _time AS behind FROM b WHERE _time < newest""")
def quality_disorder(spark, sf):
    rows = events(spark, sf).withColumn("arrival", F.expr("_time + num % 7200 * 1000000000L"))
    return ct.disorder(rows, arrival="arrival")


@query("hot_seconds_tumbling", E + f"""
SELECT inst, seq, _time, nth FROM (SELECT _cpu AS inst, seq, _time, row_number() OVER (PARTITION BY _cpu,
  _time // {6 * HOUR} ORDER BY _time, seq) AS nth FROM e) WHERE nth >= 10""")
def hot_seconds_tumbling(spark, sf):
    return hot_seconds(events(spark, sf), freq=20, pct=50, second=6 * HOUR, anchored=False)


@query("hot_seconds", E.replace("WITH e", "WITH RECURSIVE e") + f"""
, x AS (SELECT _cpu AS inst, seq, _time, row_number() OVER (PARTITION BY _cpu ORDER BY _time, seq) AS i FROM e),
n AS (SELECT a.inst, a.i, a._time, (SELECT min(b.i) FROM x b WHERE b.inst = a.inst AND b._time >= a._time + {6 * HOUR}) AS nxt
  FROM x a),
w(inst, i, nxt) AS (SELECT inst, i, nxt FROM n WHERE i = 1
  UNION ALL SELECT n.inst, n.i, n.nxt FROM w JOIN n ON n.inst = w.inst AND n.i = w.nxt),
y AS (SELECT x.*, (SELECT max(w.i) FROM w WHERE w.inst = x.inst AND w.i <= x.i) AS start FROM x)
SELECT inst, seq, _time, i - start + 1 AS nth FROM y WHERE i <> start AND i - start + 1 >= 10""")
def hot_seconds_anchored(spark, sf):
    return hot_seconds(events(spark, sf), freq=20, pct=50, second=6 * HOUR)


@query("trace_list", E + " SELECT _time, seq, _cpu, _pid, event, num FROM e WHERE k < 30 AND event <> 'error' ORDER BY _time, seq")
def trace_list(spark, sf):
    return ct.trace(events(spark, sf), ["_time", "seq", "_cpu", "_pid", "event", "num"], "k < 30 AND event <> 'error'")

