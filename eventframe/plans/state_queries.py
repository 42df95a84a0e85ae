"""Task states, time on CPU, migrations, IO stages, exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import int_div
from ..operators import states as sm
from ..operators.rangejoin import overlap_join
from ..operators.timeline import prev, timeline
from ..schema import epoch_ns
from .pair_queries import STATS, SWITCHES, switches, wakeups
from .registry import DAY, E, events, query, table

# click = switch-in, view = switch-out to S, purchase = preempted, signup = wakeup, error = wakeup_new.
MOVES = E + """
, m0 AS (SELECT _pid AS task, CASE event WHEN 'click' THEN 'in' WHEN 'signup' THEN 'wake' WHEN 'error' THEN 'new'
      ELSE 'out' END AS kind, CASE event WHEN 'view' THEN 'S' WHEN 'purchase' THEN 'R' END AS state, _time, seq FROM e),
m1 AS (SELECT *, coalesce(state = 'S', false) AS sleeps FROM m0),
m2 AS (SELECT *, lag(sleeps) OVER w AS ps FROM m1 WINDOW w AS (PARTITION BY task ORDER BY _time, seq)),
m3 AS (SELECT task, kind, state, sleeps, _time, seq, lag(sleeps) OVER w AS ps, lag(state) OVER w AS pstate,
    lag(_time) OVER w AS pt, lag(seq) OVER w AS pseq FROM m2 WHERE NOT (kind = 'wake' AND ps IS NOT NULL AND NOT ps)
    WINDOW w AS (PARTITION BY task ORDER BY _time, seq)),
st AS (SELECT task, CASE WHEN kind IN ('wake', 'new') THEN CASE WHEN ps THEN pstate END WHEN kind = 'out' AND NOT ps
      THEN 'R' WHEN kind = 'in' AND NOT ps THEN 'RD' END AS state, pt AS from_time, _time AS to_time, pseq AS from_id,
    seq AS to_id, _time - pt AS duration FROM m3 WHERE pt < _time),
states AS (SELECT * FROM st WHERE state IS NOT NULL)"""


def moves(spark, sf):
    kind = (F.when(F.col("event") == "click", "in").when(F.col("event") == "signup", "wake")
            .when(F.col("event") == "error", "new").otherwise("out"))
    state = F.when(F.col("event") == "view", "S").when(F.col("event") == "purchase", "R")
    return events(spark, sf).select(F.col("_pid").alias("task"), kind.alias("kind"), state.alias("state"), "_time", "seq")


@query("task_state", MOVES + " SELECT * FROM states")
def task_state(spark, sf):
    return sm.task_states(moves(spark, sf))


@query("task_state_stats", MOVES + f" SELECT state, {STATS.replace('latency', 'duration')} FROM states GROUP BY state")
def task_state_stats(spark, sf):
    return sm.state_stats(sm.task_states(moves(spark, sf)), wide=None)


@query("task_state_sd", MOVES + """
, q AS (SELECT *, lag(sleeps) OVER w AS p, lag(_time) OVER w AS t, lag(seq) OVER w AS i FROM m1
  WHERE (sleeps OR kind = 'wake') AND task BETWEEN 20 AND 120 WINDOW w AS (PARTITION BY task ORDER BY _time, seq))
SELECT task, 'S' AS state, t AS from_time, _time AS to_time, i AS from_id, seq AS to_id, _time - t AS duration
FROM q WHERE kind = 'wake' AND p AND t < _time""")
def task_state_sd(spark, sf):
    return sm.task_states(moves(spark, sf), only=("S", "D"), tasks=F.col("task").between(20, 120))


@query("task_state_outliers", MOVES + f" SELECT * FROM states WHERE duration > {2 * DAY} AND state <> 'R'")
def task_state_outliers(spark, sf):
    return sm.state_outliers(sm.task_states(moves(spark, sf)), 2 * DAY)


@query("task_moves_from_switches", E + SWITCHES + """
SELECT task, kind, state, _time, seq FROM (
  SELECT prev_pid AS task, 'out' AS kind, CASE prev_state WHEN 0 THEN 'R' ELSE 'S' END AS state, _time, seq FROM sw
  UNION ALL SELECT next_pid, 'in', NULL, _time, seq FROM sw) WHERE task > 0
UNION ALL SELECT pid, CASE kind WHEN 'sched_wakeup' THEN 'wake' ELSE 'new' END, NULL, _time, seq FROM wk""")
def task_moves_from_switches(spark, sf):
    sw = switches(spark, sf).withColumn("prev_state", F.when(F.col("prev_state") == 0, "R").otherwise("S"))
    return sm.task_moves(sw, wakeups(spark, sf))


# On each CPU the previous row's task leaves and the row's own task comes in (every event is a switch).
ONCPU = E + """
, o AS (SELECT _cpu AS cpu, lag(_pid) OVER w AS tid, lag(_time, 1) OVER w AS start, _time AS "end",
    lag(_pid, 1) OVER w AS before FROM e WINDOW w AS (PARTITION BY _cpu ORDER BY _time, seq)),
sl AS (SELECT cpu, tid, start, "end", "end" - start AS runtime FROM o WHERE start IS NOT NULL AND tid <> 0)"""


def cpu_switches(spark, sf):
    seen = timeline(events(spark, sf), "_cpu").scan(_p=prev("_pid")).rows()
    return seen.withColumns({"prev_pid": F.col("_p._pid"), "next_pid": F.col("_pid"), "prev_prio": F.expr("100 + k % 40")})


@query("oncpu_by_cpu", ONCPU + """
SELECT cpu, tid, CAST(sum(runtime) AS BIGINT) AS runtime, count(*) AS switches, max(runtime) AS max FROM sl GROUP BY cpu, tid""")
def oncpu_by_cpu(spark, sf):
    return sm.oncpu_by_cpu(cpu_switches(spark, sf))


RUNTIMES = E + """, rt AS (SELECT _tid AS tid, k % 4 AS cpu, num AS runtime FROM e WHERE event = 'click' AND k % 10 <> 0),
pc AS (SELECT tid, cpu, CAST(sum(runtime) AS BIGINT) AS runtime FROM rt GROUP BY tid, cpu)"""


def runtimes(spark, sf):
    rows = events(spark, sf).where("event = 'click'")
    # Every tenth runtime was recorded on behalf of another task and must be ignored.
    return rows.select("_tid", F.expr("k % 4").alias("_cpu"), F.expr("if(k % 10 = 0, _tid + 1, _tid)").alias("pid"),
                       F.col("num").alias("runtime"))


@query("oncpu_by_tid", RUNTIMES + """
SELECT tid, CAST(sum(runtime) AS BIGINT) AS runtime, string_agg(cpu || ':' || runtime, ' ' ORDER BY cpu) AS cpus
FROM pc GROUP BY tid""")
def oncpu_by_tid(spark, sf):
    return sm.oncpu_by_tid(runtimes(spark, sf))


@query("oncpu_corun", RUNTIMES + """
SELECT tid, runtime, co, co * 100 // runtime AS co_pct FROM (
  SELECT a.tid, CAST(sum(a.runtime) AS BIGINT) AS runtime,
    CAST(coalesce(sum(CASE WHEN b.runtime IS NOT NULL THEN least(a.runtime, b.runtime) END), 0) AS BIGINT) AS co
  FROM pc a LEFT JOIN pc b ON b.tid = xor(a.tid, 1) AND b.cpu = xor(a.cpu, 1) GROUP BY a.tid)""")
def oncpu_corun(spark, sf):
    per_cpu = sm.runtime_by_tid_cpu(runtimes(spark, sf)).select("tid", "cpu", "runtime")
    threads = per_cpu.select("tid").distinct().withColumn("sib_tid", F.expr("tid ^ 1"))
    cpus = spark.range(4).select(F.col("id").cast("int").alias("cpu"), F.expr("cast(id ^ 1 as int)").alias("sib_cpu"))
    return sm.corun(per_cpu, threads, cpus)


@query("migrate_locality", E + """
, g AS (SELECT event, lag(k) OVER (PARTITION BY _pid ORDER BY _time, seq) % 8 AS o, k % 8 AS d FROM e)
SELECT event, count(*) AS total, CAST(sum(CAST(o // 4 = d // 4 AS INT)) AS BIGINT) AS same_llc,
  CAST(sum(CAST(o // 2 = d // 2 AS INT)) AS BIGINT) AS same_l2,
  CAST(sum(CAST(o // 4 = d // 4 AS INT)) * 100 // count(*) AS BIGINT) AS llc_pct,
  CAST(sum(CAST(o // 2 = d // 2 AS INT)) * 100 // count(*) AS BIGINT) AS l2_pct FROM g WHERE o IS NOT NULL GROUP BY event""")
def migrate_locality(spark, sf):
    seen = timeline(events(spark, sf), "_pid").scan(_p=prev("k")).rows().where("_p IS NOT NULL")
    jumps = seen.select("event", F.expr("_p.k % 8").alias("orig_cpu"), F.expr("k % 8").alias("dest_cpu"))
    topology = spark.range(8).selectExpr("cast(id as int) AS cpu", "cast(id div 2 as int) AS l2",
                                         "cast(id div 4 as int) AS llc")
    return sm.migrate_locality(jumps, topology, by=["event"])


STAGES = ["getrq", "insert", "issue", "complete"]
IO = """WITH q AS (SELECT l_suppkey AS dev, l_partkey AS sector, epoch_us(l_shipdate) // 1000 AS _time,
    l_orderkey * 8 + l_linenumber AS seq, 1 + l_linenumber % 4 AS r FROM lineitem),
q1 AS (SELECT *, lag(r) OVER w AS pr, lag(_time) OVER w AS pt FROM q
    WINDOW w AS (PARTITION BY dev, sector ORDER BY _time, seq)),
q2 AS (SELECT ['getrq', 'insert', 'issue', 'complete'][r] AS stage, r, pr, _time - pt AS delay FROM q1 WHERE pr <> 4)"""


def io_requests(spark, sf):
    names = F.array(*[F.lit(s) for s in STAGES])
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("dev"), F.col("l_partkey").alias("sector"),
        int_div(epoch_ns("l_shipdate"), F.lit(1_000_000)).alias("_time"),   # ms: the delays are years
        F.expr("l_orderkey * 8 + l_linenumber").alias("seq"), F.get(names, F.expr("l_linenumber % 4")).alias("event"))


@query("io_stages", IO + f"""
SELECT stage, count(*) AS reqs, CAST(sum(delay) AS BIGINT) AS total, min(delay) AS min, max(delay) AS max,
  CAST(sum(delay) AS BIGINT) // count(*) AS avg, count(*) FILTER (delay > {100 * DAY // 1_000_000}) AS than FROM q2 GROUP BY stage""")
def io_stages(spark, sf):
    return sm.io_stages(io_requests(spark, sf), STAGES, than=100 * DAY // 1_000_000)


@query("io_flags", IO + """
SELECT stage, flag, count(*) AS n FROM (SELECT stage, CASE WHEN r = 1 THEN 'EXIST' WHEN pr <> r - 1 THEN
  CASE WHEN r = 3 THEN 'BYPASS_INSERT' ELSE 'LOST' END END AS flag FROM q2) WHERE flag IS NOT NULL GROUP BY ALL""")
def io_flags(spark, sf):
    return sm.io_flags(io_requests(spark, sf), STAGES)


# The same requests with ranges of two to eight sectors on a grid of two.
MERGED = IO.split(",\nq1")[0].replace("l_partkey AS sector,", """l_partkey // 8 * 2 AS sector,
    (1 + l_linenumber % 4) * 2 AS nr,""") + """,
b AS (SELECT q.*, unnest(range(sector // 2, (sector + nr) // 2)) AS blk FROM q),
l AS (SELECT dev, seq, _time, r, lag(seq) OVER w AS pseq, lag(_time) OVER w AS pt, lag(r) OVER w AS pr FROM b
    WINDOW w AS (PARTITION BY dev, blk ORDER BY _time, seq)),
m AS (SELECT DISTINCT dev, seq, _time, r, pseq, pt, pr FROM l WHERE pseq IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY dev, pt, pseq ORDER BY _time, seq) AS a FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY dev, _time, seq ORDER BY pt DESC, pseq DESC) AS z FROM n
    WHERE a = 1 AND pr <> 4),
q2 AS (SELECT ['getrq', 'insert', 'issue', 'complete'][r] AS stage, _time - pt AS delay FROM o WHERE z = 1)"""


@query("io_stages_merged", MERGED + """
SELECT stage, count(*) AS reqs, CAST(sum(delay) AS BIGINT) AS total, min(delay) AS min, max(delay) AS max,
  CAST(sum(delay) AS BIGINT) // count(*) AS avg FROM q2 GROUP BY stage""")
def io_stages_merged(spark, sf):
    ranges = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("dev"), F.expr("l_partkey div 8 * 2").alias("sector"),
        F.expr("(1 + l_linenumber % 4) * 2").alias("nr_sector"),
        int_div(epoch_ns("l_shipdate"), F.lit(1_000_000)).alias("_time"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("seq"),
        F.get(F.array(*[F.lit(s) for s in STAGES]), F.expr("l_linenumber % 4")).alias("event"))
    return sm.io_stages(ranges, STAGES, by=["dev"], merged=True)


EXITS = E + """
, x0 AS (SELECT *, k % 2 AS isa, k % 6 AS reason, num AS guest_ip FROM e WHERE event IN ('view', 'click')),
x1 AS (SELECT *, last_value(CASE WHEN event = 'view' THEN seq END IGNORE NULLS) OVER (PARTITION BY _cpu
    ORDER BY _time, seq ROWS UNBOUNDED PRECEDING) AS open FROM x0),
x2 AS (SELECT b._cpu AS inst, a.seq AS exit_id, b.seq AS entry_id, a._tid AS tid, a.isa, a.reason, a.guest_ip,
    a._time AS start_time, b._time AS end_time, b._time - a._time AS latency,
    row_number() OVER (PARTITION BY a.seq ORDER BY b._time, b.seq) AS rn
  FROM x1 b JOIN x0 a ON a.seq = b.open WHERE b.event = 'click' AND a._tid = b._tid AND a._time < b._time),
x AS (SELECT * EXCLUDE rn FROM x2 WHERE rn = 1)"""


def exits(spark, sf, by_cpu="_cpu"):
    e = events(spark, sf).withColumns({"isa": F.expr("k % 2"), "reason": F.expr("k % 6"), "guest_ip": F.col("num")})
    return sm.exit_spans(e.where("event = 'view'"), e.where("event = 'click'"), by_cpu)


@query("exit_spans", EXITS.replace("PARTITION BY _cpu", "PARTITION BY _tid").replace("b._cpu AS inst", "b._tid AS inst")
       + " SELECT * FROM x")
def exit_spans(spark, sf):
    return exits(spark, sf, "_tid")


@query("exit_stats", EXITS.replace("PARTITION BY _cpu", "PARTITION BY _tid").replace("b._cpu AS inst", "b._tid AS inst") + f"""
SELECT isa, reason, count(*) AS calls, CAST(sum(latency) AS BIGINT) AS total, min(latency) AS min,
  CAST(sum(latency) AS BIGINT) // count(*) AS avg, CAST(quantile_disc(latency, 0.99) AS BIGINT) AS p99,
  max(latency) AS max, count(*) FILTER (latency > {DAY} AND NOT (isa = 1 AND reason = 1)) AS than,
  round(CAST(sum(CASE WHEN guest_ip >= 5000 THEN latency ELSE 0 END) AS DOUBLE) * 100 / CAST(sum(latency) AS DOUBLE), 2)
    AS gsys_pct FROM x GROUP BY isa, reason""")
def exit_stats(spark, sf):
    return sm.exit_stats(exits(spark, sf, "_tid"), kernel_start=5000, than=DAY, hlt={1: 1}, wide=None)


@query("span_breakdown", MOVES + """
, v AS (SELECT _pid AS task, seq AS span_id, _time AS start_time, _time + 86400000000000 AS end_time FROM e
  WHERE event = 'error'),
j AS (SELECT span_id, state, least(v.end_time, s.to_time) - greatest(v.start_time, s.from_time) AS part,
    s.to_time <= v.end_time AS inside FROM v JOIN states s ON s.task = v.task AND v.start_time < s.to_time
    AND s.from_time < v.end_time),
a AS (SELECT span_id, CAST(sum(CASE WHEN state = 'S' THEN part ELSE 0 END) AS BIGINT) AS wait,
    CAST(sum(CASE WHEN state = 'RD' THEN part ELSE 0 END) AS BIGINT) AS rundelay,
    count(*) FILTER (state = 'RD' AND inside) AS switches FROM j GROUP BY span_id)
SELECT span_id, task, end_time - start_time AS latency, coalesce(wait, 0) AS wait, coalesce(rundelay, 0) AS rundelay,
  end_time - start_time - coalesce(wait, 0) - coalesce(rundelay, 0) AS own, coalesce(switches, 0) AS switches
FROM v LEFT JOIN a USING (span_id)""")
def span_breakdown(spark, sf):
    spans = events(spark, sf).where("event = 'error'").select(
        F.col("seq").alias("span_id"), F.col("_pid").alias("task"), F.col("_time").alias("start_time"),
        (F.col("_time") + DAY).alias("end_time"))
    slices = sm.task_states(moves(spark, sf)).select(
        F.col("task").alias("slice_task"), "state", F.col("from_time").alias("slice_start"),
        F.col("to_time").alias("slice_end"))
    return sm.span_breakdown(spans, slices)


@query("join_overlap", """
WITH a AS (SELECT l_linenumber AS dev, l_orderkey AS a_id, l_linenumber AS a_no, l_partkey AS a0,
    l_partkey + 2 + l_linenumber AS a1 FROM lineitem),
b AS (SELECT p_size % 7 + 1 AS b_dev, p_partkey AS b_id, p_partkey - p_size % 8 AS b0, p_partkey AS b1 FROM part)
SELECT a_id, a_no, b_id FROM a JOIN b ON dev = b_dev AND a0 < b1 AND b0 < a1""")
def join_overlap(spark, sf):
    a = table(spark, sf, "lineitem").selectExpr(
        "l_linenumber AS dev", "l_orderkey AS a_id", "l_linenumber AS a_no", "l_partkey AS a0",
        "l_partkey + 2 + l_linenumber AS a1")
    b = table(spark, sf, "part").selectExpr(
        "p_size % 7 + 1 AS b_dev", "p_partkey AS b_id", "p_partkey - p_size % 8 AS b0", "p_partkey AS b1")
    return overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), [("dev", "b_dev")]).select("a_id", "a_no", "b_id")
