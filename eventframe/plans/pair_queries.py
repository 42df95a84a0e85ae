"""Pairing, latency statistics, detail view, run delay, system calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as ctx
from ..operators import pairs as pr
from ..operators import stats as st
from ..operators.timeline import prev, timeline
from .registry import DAY, E, EPOCH_2024, HOUR, events, query

CHAIN = [["view", "click"], ["purchase"], ["signup"]]
TWO = [["view", "click"], ["purchase"]]

# Level, start and end bits of the three-level chain, then the predecessor on the same key.
ROLE = """CASE event WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 END"""


def chain_sql(key: str = "_tid", bits: str = "3", levels: int = 3, cycle: bool = False, extra: str = "",
              source: str = "e", part: str = "key", starts: str = "true") -> str:
    last = levels - 1
    s = "true" if cycle else f"level <> {last}"
    f = "true" if cycle else "level <> 0"
    hop = f"(plevel + 1) % {levels} = level" if cycle else "plevel + 1 = level"
    w = f"OVER (PARTITION BY {part} ORDER BY _time, seq)"
    return f"""
, r0 AS (SELECT *, {key} AS key, {ROLE} AS level, {bits} AS bits FROM {source}),
r1 AS (SELECT *, (bits & 1) <> 0 AND {s} AND {starts} AS starts, (bits & 2) <> 0 AND {f} AS ends FROM r0
       WHERE level < {levels} {extra}),
r2 AS (SELECT *, lag(event) {w} AS pevent, lag(seq) {w} AS pseq, lag(_time) {w} AS ptime, lag(_cpu) {w} AS pcpu,
  lag(_tid) {w} AS ptid, lag(level) {w} AS plevel, lag(starts) {w} AS pstarts FROM r1 WHERE starts OR ends),
p AS (SELECT key, pevent AS start, event AS "end", pseq AS start_id, seq AS end_id, ptime AS start_time,
  _time AS end_time, _time - ptime AS latency, pcpu AS start_cpu, _cpu AS end_cpu, ptid AS start_tid, _tid AS end_tid
  FROM r2 WHERE ends AND pstarts AND ptime < _time AND {hop})"""


PAIRS = E + chain_sql(levels=2)
STATS = """count(*) AS calls, CAST(sum(latency) AS BIGINT) AS total, min(latency) AS min,
  CAST(quantile_disc(latency, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(latency, 0.95) AS BIGINT) AS p95,
  CAST(quantile_disc(latency, 0.99) AS BIGINT) AS p99, max(latency) AS max"""


def two(spark, sf):
    return pr.pair_events(events(spark, sf), TWO)


@query("pair_delay", PAIRS + " SELECT * FROM p")
def pair_delay(spark, sf):
    return two(spark, sf)


@query("pair_chain", E + chain_sql() + " SELECT * FROM p")
def pair_chain(spark, sf):
    return pr.pair_events(events(spark, sf), CHAIN)


@query("pair_cycle", E + chain_sql(cycle=True) + " SELECT * FROM p")
def pair_cycle(spark, sf):
    return pr.pair_events(events(spark, sf), CHAIN, cycle=True)


@query("pair_role", E + chain_sql(bits="CASE WHEN event = 'purchase' THEN k % 4 ELSE 3 END") + " SELECT * FROM p")
def pair_role(spark, sf):
    return pr.pair_events(events(spark, sf), CHAIN, role={"purchase": "k % 4"})


@query("pair_keyexpr", E + chain_sql(key="CASE event WHEN 'view' THEN _tid * 2 + k % 2 WHEN 'click' THEN _tid * 2 ELSE _tid * 2 END") + " SELECT * FROM p")
def pair_keyexpr(spark, sf):
    key = {"view": "_tid * 2 + k % 2", "click": "_tid * 2", "purchase": "_tid * 2", "signup": "_tid * 2"}
    return pr.pair_events(events(spark, sf), CHAIN, key=key)


@query("delay_stats", PAIRS + f" SELECT start, \"end\", {STATS} FROM p GROUP BY start, \"end\"")
def delay_stats(spark, sf):
    return st.delay_stats(two(spark, sf), wide=None)


@query("delay_stats_by_key", PAIRS + f" SELECT key, start, \"end\", {STATS} FROM p GROUP BY key, start, \"end\"")
def delay_stats_by_key(spark, sf):
    return st.delay_stats(two(spark, sf), by=["key"], wide=None)


THAN = f"CAST(count(*) FILTER (latency > {DAY}) AS BIGINT) AS than"


@query("delay_than", PAIRS + f"""
SELECT *, than * 100 // calls AS than_pct FROM (SELECT start, "end", {STATS}, {THAN} FROM p GROUP BY start, "end")""")
def delay_than(spark, sf):
    return st.delay_stats(two(spark, sf), than=DAY, only_than=True, wide=None)


@query("delay_outliers", PAIRS + f" SELECT * FROM p WHERE latency > {2 * DAY} OR latency < {HOUR // 60}")
def delay_outliers(spark, sf):
    return pr.outliers(two(spark, sf), than=2 * DAY, lower=HOUR // 60)


@query("delay_sorted", PAIRS + f"""
SELECT end_cpu, start, "end", {STATS} FROM p GROUP BY ALL ORDER BY end_cpu, total DESC, start, "end" """)
def delay_sorted(spark, sf):
    return st.delay_stats(two(spark, sf), by=["end_cpu"], sort=True, wide=None)


# The detail view runs on a fleet whose cpus and processes grow with its users: four users share one of each.
FLEET = E + """, f AS (SELECT event, _time, seq, CAST((_tid + 2) // 4 AS INT) AS _cpu, _tid // 4 AS _pid, _tid, k FROM e)"""


def detail_sql(match: str) -> str:
    return FLEET + chain_sql(levels=2, source="f") + f""", d AS (
SELECT end_id AS pair_id, start_id, CASE
    WHEN f._time < start_time OR (f._time = start_time AND seq < start_id) THEN 'before'
    WHEN seq = start_id THEN 'start' WHEN seq = end_id THEN 'end'
    WHEN f._time > end_time OR (f._time = end_time AND seq > end_id) THEN 'after' ELSE 'between' END AS part,
  f._time - start_time AS "offset", event, _time, seq, _cpu, _pid, k
FROM p JOIN f ON ({match}) AND f._time BETWEEN start_time - {HOUR} AND end_time + {HOUR} WHERE latency > {DAY})"""


def detail(spark, sf, same):
    e = events(spark, sf).withColumns({"_cpu": F.expr("int((_tid + 2) div 4)"), "_pid": F.expr("_tid div 4")})
    pairs = pr.pair_events(e, TWO, carry=("_pid",))
    return ctx.context(pairs, e.select("event", "_time", "seq", "_cpu", "_pid", "k"), HOUR, HOUR, same=same, than=DAY)


@query("detail_context", detail_sql("f._cpu = end_cpu") + " SELECT * FROM d")
def detail_context(spark, sf):
    return detail(spark, sf, "cpu")


@query("detail_samepid", detail_sql("f._pid = end_tid // 4") + " SELECT * FROM d")
def detail_samepid(spark, sf):
    return detail(spark, sf, "pid")


@query("detail_multi", detail_sql("f._cpu = end_cpu OR f._pid = end_tid // 4") + " SELECT * FROM d")
def detail_multi(spark, sf):
    return detail(spark, sf, ("cpu", "pid"))


STAYS = f""", r AS (SELECT _tid AS who, k % 38 AS cpu, _time AS a, coalesce(lead(_time) OVER (PARTITION BY _tid ORDER BY _time, seq), {1 << 62}) AS b
  FROM f WHERE event = 'error'), d AS ("""


@query("detail_migrating", detail_sql("TRUE").replace(", d AS (", STAYS).replace(
    f"WHERE latency > {DAY})", f"""LEFT JOIN r ON r.who = start_tid AND r.a <= f._time AND f._time < r.b
WHERE latency > {DAY} AND f._cpu = coalesce(r.cpu, start_cpu))""") + " SELECT * FROM d")
def detail_migrating(spark, sf):
    """An error moves its task to another CPU, often inside a pair."""
    e = events(spark, sf).withColumns({"_cpu": F.expr("int((_tid + 2) div 4)"), "_pid": F.expr("_tid div 4")})
    pairs = pr.pair_events(e, TWO).where(f"latency > {DAY}")
    found = ctx.context_on_cpu(pairs, e, {"error": ("_tid", "k % 38")}, HOUR, HOUR)
    return found.select("pair_id", "start_id", "part", "offset", "event", "_time", "seq", "_cpu", "_pid", "k")


@query("detail_hide", detail_sql("f._cpu = end_cpu") + f"""
, g AS (SELECT *, CASE WHEN _time - lag(_time) OVER w < {HOUR // 2} THEN 1 ELSE 0 END AS close
  FROM d WHERE part = 'between' WINDOW w AS (PARTITION BY pair_id ORDER BY _time, seq)),
h AS (SELECT *, sum(1 - close) OVER (PARTITION BY pair_id ORDER BY _time, seq) AS run FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY pair_id, run ORDER BY _time, seq) AS up,
  row_number() OVER (PARTITION BY pair_id, run ORDER BY _time DESC, seq DESC) AS down,
  count(*) OVER (PARTITION BY pair_id, run) - 1 AS n, max(run) OVER (PARTITION BY pair_id) = run AS is_last FROM h)
SELECT pair_id, event, seq, _time, "offset", 0::BIGINT AS hidden FROM i WHERE up = 1
UNION ALL SELECT pair_id, event, seq, _time, "offset", n - 1 FROM i WHERE down = 1 AND n > 0 AND NOT is_last
UNION ALL SELECT pair_id, NULL, NULL, NULL, NULL, n FROM i WHERE down = 1 AND n > 0 AND is_last""")
def detail_hide(spark, sf):
    return ctx.hide_close(detail(spark, sf, "cpu"), HOUR // 2)


@query("epoch_by_trigger", E + """
, t AS (SELECT *, CAST(sum(CASE WHEN event = 'signup' AND k = 42 THEN 1 ELSE 0 END)
    OVER (ORDER BY _time, seq) AS BIGINT) AS epoch FROM e)
SELECT epoch, event, count(*) AS n, CAST(sum(num) AS BIGINT) AS total FROM t GROUP BY ALL""")
def epoch_by_trigger(spark, sf):
    marked = pr.epochs(events(spark, sf), "event = 'signup' AND k = 42")
    return marked.groupBy("epoch", "event").agg(F.count("*").alias("n"), F.sum("num").alias("total"))


@query("track_cpu", E + """
SELECT seq, event, _tid, last_value(CASE event WHEN 'signup' THEN k % 8 WHEN 'click' THEN _cpu END IGNORE NULLS)
  OVER (PARTITION BY _tid ORDER BY _time, seq ROWS UNBOUNDED PRECEDING) AS on_cpu FROM e""")
def track_cpu(spark, sf):
    moves = {"signup": ("_tid", "k % 8"), "click": ("_tid", "_cpu")}
    return pr.track_cpu(events(spark, sf), moves).select("seq", "event", "_tid", "on_cpu")


@query("pair_counts", E + chain_sql() + ' SELECT start, "end", count(*) AS paired FROM p GROUP BY ALL')
def pair_counts(spark, sf):
    return pr.pair_counts(pr.pair_events(events(spark, sf), CHAIN))


@query("pair_unpaired", E + chain_sql() + """
SELECT key, event, seq, _time, _cpu, _tid FROM
  (SELECT *, row_number() OVER (PARTITION BY key ORDER BY _time DESC, seq DESC) AS rn FROM r2) WHERE rn = 1 AND starts""")
def pair_unpaired(spark, sf):
    return pr.unpaired(events(spark, sf), CHAIN)


@query("pair_orphans", E + chain_sql() + """
, q AS (SELECT *, coalesce(ends AND pstarts AND ptime < _time AND plevel + 1 = level, false) AS paired,
    row_number() OVER (PARTITION BY key ORDER BY _time DESC, seq DESC) AS rn FROM r2)
SELECT key, event, seq, _time, _cpu, _tid, 'open' AS reason FROM q WHERE rn = 1 AND starts
UNION ALL SELECT key, event, seq, _time, _cpu, _tid, 'end' FROM q WHERE ends AND NOT starts AND NOT paired
UNION ALL SELECT key, pevent, pseq, ptime, pcpu, ptid, 'overwritten' FROM q WHERE pstarts AND NOT paired""")
def pair_orphans(spark, sf):
    return pr.unpaired(events(spark, sf), CHAIN, report_orphans=True)


AT = EPOCH_2024 + 20 * DAY


@query("pair_open_age", E.replace("FROM events)", f"FROM events WHERE epoch_us(ts) * 1000 <= {AT})") + chain_sql() + f"""
SELECT key, event, seq, _time, _cpu, _tid, {AT} - _time AS age FROM
  (SELECT *, row_number() OVER (PARTITION BY key ORDER BY _time DESC, seq DESC) AS rn FROM r2)
WHERE rn = 1 AND starts AND {AT} - _time > {6 * HOUR}""")
def pair_open_age(spark, sf):
    return pr.open_starts(events(spark, sf), CHAIN, at=AT, older_than=6 * HOUR)


# Scheduling view of the events: view, click, purchase are switches on their CPU (the task that leaves is the one the
# previous switch brought in); signup and error are wakeups.
SWITCHES = """, s0 AS (SELECT *, lag(_pid) OVER (PARTITION BY _cpu ORDER BY _time, seq) AS prev_pid, k % 2 AS prev_state,
  _pid AS next_pid FROM e WHERE event IN ('view', 'click', 'purchase')),
sw AS (SELECT * FROM s0 WHERE prev_pid <> next_pid),
wk AS (SELECT *, CASE event WHEN 'signup' THEN 'sched_wakeup' ELSE 'sched_wakeup_new' END AS kind, _pid AS pid
  FROM e WHERE event IN ('signup', 'error'))"""


def switches(spark, sf):
    rows = events(spark, sf).where(F.col("event").isin("view", "click", "purchase"))
    seen = timeline(rows, "_cpu").scan(_p=prev("_pid")).rows()
    return seen.withColumns({"prev_pid": F.col("_p._pid"), "prev_state": F.expr("k % 2"), "next_pid": F.col("_pid")}
                            ).where("prev_pid <> next_pid").drop("_p")


def wakeups(spark, sf):
    return events(spark, sf).where(F.col("event").isin("signup", "error")).withColumns({
        "event": F.when(F.col("event") == "signup", "sched_wakeup").otherwise("sched_wakeup_new"),
        "pid": F.col("_pid")})


@query("rundelay", E + SWITCHES + """
, m AS (SELECT kind AS event, pid AS key, _time, seq, true AS starts FROM wk
  UNION ALL SELECT 'preempted', prev_pid, _time, seq, true FROM sw WHERE prev_state = 0 AND prev_pid > 0
  UNION ALL SELECT 'switch_in', next_pid, _time, seq, false FROM sw),
n AS (SELECT *, lag(event) OVER w AS start, lag(starts) OVER w AS ps, lag(_time) OVER w AS pt, lag(seq) OVER w AS pid
  FROM m WINDOW w AS (PARTITION BY key ORDER BY _time, seq))
SELECT key, start, pid AS start_id, seq AS end_id, _time - pt AS latency FROM n WHERE NOT starts AND ps AND pt < _time""")
def rundelay(spark, sf):
    return pr.rundelay(switches(spark, sf), wakeups(spark, sf)).select("key", "start", "start_id", "end_id", "latency")


@query("flt_unneeded_wakeup", E + """
, a AS (SELECT *, CASE WHEN event = 'click' THEN _cpu ELSE k % 8 END AS on_cpu,
    CASE WHEN event = 'click' THEN _pid END AS runs, (num + k) % 150 AS pid FROM e WHERE event IN ('click', 'signup')),
b AS (SELECT *, last_value(runs IGNORE NULLS) OVER (PARTITION BY on_cpu ORDER BY _time, seq
    ROWS UNBOUNDED PRECEDING) AS running FROM a)
SELECT event, seq, _cpu, pid FROM b WHERE NOT (event = 'signup' AND (_tid = pid OR coalesce(running = pid, false)))""")
def flt_unneeded_wakeup(spark, sf):
    rows = events(spark, sf).withColumns({"next_pid": F.col("_pid"), "pid": F.expr("(num + k) % 150"),
                                          "target_cpu": F.expr("k % 8")})
    return pr.drop_unneeded_wakeups(rows, "click", "signup").select("event", "seq", "_cpu", "pid")


@query("syscall_stats", E + """
, r AS (SELECT *, lag(event) OVER w AS pe, lag(k % 4) OVER w AS pid, lag(_time) OVER w AS pt FROM e
  WHERE event IN ('view', 'click', 'signup') WINDOW w AS (PARTITION BY _tid ORDER BY _time, seq)),
p AS (SELECT pid AS id, _time - pt AS latency, CASE WHEN event = 'click' AND k - 50 BETWEEN -4095 AND -1 THEN 1
    ELSE 0 END AS failed FROM r WHERE event <> 'view' AND pe = 'view' AND pt < _time
  AND (event = 'signup' OR pid = k % 4))
SELECT id, count(*) AS calls, CAST(sum(latency) AS BIGINT) AS total, min(latency) AS min, max(latency) AS max,
  CAST(sum(latency) AS BIGINT) // count(*) AS avg, CAST(sum(failed) AS BIGINT) AS err,
  count(*) FILTER (latency > 86400000000000) AS than FROM p GROUP BY id""")
def syscall_stats(spark, sf):
    e = events(spark, sf).withColumns({"call": F.expr("k % 4"), "ret": F.expr("k - 50")})
    pairs = pr.pair_events(e, [["view"], ["click", "signup"]], carry=["call", "ret"])
    return st.syscall_stats(pairs, free="signup", than=DAY)


@query("heatmap_bins", PAIRS + f"""
, b AS (SELECT min(end_time) AS t0, greatest(1, max(latency) // 50) AS step FROM p)
SELECT (end_time - t0) // {DAY} AS col, latency // step AS row, count(*) AS count FROM p, b GROUP BY ALL""")
def heatmap_bins(spark, sf):
    return st.heatmap(two(spark, sf), step=DAY)


# One lost range of two hours at noon of every fifth day.
RANGES = [(EPOCH_2024 + d * DAY + 12 * HOUR, EPOCH_2024 + d * DAY + 14 * HOUR) for d in range(0, 30, 5)]
LOST = ", lost(a, b) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in RANGES) + """),
kept AS (SELECT *, (SELECT count(*) FROM lost WHERE b <= _time) AS segment,
  NOT EXISTS (SELECT 1 FROM lost WHERE a = _time) AS free FROM e
  WHERE NOT EXISTS (SELECT 1 FROM lost WHERE a < _time AND _time < b))"""


def lost_ranges(spark):
    return spark.createDataFrame(RANGES, "start_time bigint, end_time bigint")


@query("pair_lost_ranges", E + LOST + chain_sql(source="kept", part="key, segment", starts="free") + " SELECT * FROM p")
def pair_lost_ranges(spark, sf):
    return pr.pair_events(events(spark, sf), CHAIN, lost=lost_ranges(spark))


@query("pair_reclaim", E + chain_sql(source="(SELECT * FROM e WHERE event <> 'signup')", levels=2).replace(
    "r0 AS (SELECT *,", "r0 AS (SELECT * EXCLUDE event, CASE event WHEN 'error' THEN 'purchase' ELSE event END AS event, "
    "event = 'error' AS gone,").replace(ROLE, "CASE WHEN event = 'error' THEN 1 ELSE " + ROLE + " END").replace(
    "WHERE ends AND pstarts", "WHERE NOT gone AND ends AND pstarts") + " SELECT * FROM p")
def pair_reclaim(spark, sf):
    return pr.pair_events(events(spark, sf), TWO, reclaim=["error"])
