"""Nested calls over the events: view/click enter and leave f, purchase/signup enter and leave g."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as ca
from .pair_queries import STATS
from .registry import E, events, query

FUNCTIONS = {"f": ("view", "click"), "g": ("purchase", "signup")}

CALLS = E + """
, c0 AS (SELECT _tid AS key, _time, seq, CASE WHEN event IN ('view', 'click') THEN 'f' ELSE 'g' END AS fn,
    CASE WHEN event IN ('view', 'purchase') THEN 1 ELSE -1 END AS d FROM e WHERE event <> 'error'),
c1 AS (SELECT *, CAST(sum(d) OVER (PARTITION BY key, fn ORDER BY _time, seq) AS BIGINT) AS s FROM c0),
c2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key, fn ORDER BY _time, seq)) AS held FROM c1),
c3 AS (SELECT *, CASE WHEN d = 1 THEN held ELSE held + 1 END AS again FROM c2),
c4 AS (SELECT *, lag(d) OVER w AS pd, lag(_time) OVER w AS pt, lag(seq) OVER w AS ps FROM c3
    WINDOW w AS (PARTITION BY key, fn, again ORDER BY _time, seq)),
c5 AS (SELECT *, CAST(sum(d) OVER (PARTITION BY key ORDER BY _time, seq) AS BIGINT) AS depth FROM c4
    WHERE d = 1 OR pd = 1),
c AS (SELECT *, CASE WHEN d = 1 THEN depth ELSE depth + 1 END AS level FROM c5),
matched AS (SELECT key, fn, level, CAST(again > 1 AS INT) AS recursive, ps AS entry_id, seq AS ret_id, pt AS entry_time,
    _time AS ret_time, _time - pt AS latency FROM c WHERE d = -1),
x AS (SELECT key, fn, level, again, seq, _time, level AS grp, NULL AS cand, 1 AS child FROM c WHERE d = 1
    UNION ALL SELECT key, fn, level, again, seq, _time, level + 1, fn, 0 FROM c WHERE d = 1),
y AS (SELECT *, last_value(cand IGNORE NULLS) OVER (PARTITION BY key, grp ORDER BY _time, seq
    ROWS UNBOUNDED PRECEDING) AS pf FROM x),
callers AS (SELECT key, fn, level, CAST(again > 1 AS INT) AS recursive, seq, _time,
    CASE WHEN level > 1 THEN pf ELSE 'root' END AS caller FROM y WHERE child = 1)"""


def rows(spark, sf):
    return ca.call_rows(events(spark, sf), FUNCTIONS)


@query("call_match", CALLS + " SELECT * FROM matched")
def call_match(spark, sf):
    return ca.match_calls(rows(spark, sf))


@query("call_depth", CALLS + " SELECT * FROM callers")
def call_depth(spark, sf):
    return ca.callers(rows(spark, sf))


@query("call_edges", CALLS + """
SELECT caller, fn AS callee, count(*) AS calls, min(level) - 1 AS depth, max(recursive) AS recursive
FROM callers GROUP BY caller, fn""")
def call_edges(spark, sf):
    return ca.call_edges(rows(spark, sf))


@query("call_delay", CALLS + f"""
SELECT fn, {STATS}, any_value(depth) AS depth, any_value(recursive) AS recursive FROM matched_only JOIN
  (SELECT fn, min(level) - 1 AS depth, max(CAST(again > 1 AS INT)) AS recursive FROM c WHERE d = 1 GROUP BY fn)
  USING (fn) GROUP BY fn""".replace("matched_only", "(SELECT fn, latency FROM matched)"))
def call_delay(spark, sf):
    return ca.call_delay(rows(spark, sf), wide=None)


@query("call_nesting_errors", CALLS + """
, t AS (SELECT *, lag(fn) OVER w AS tf, lag(d) OVER w AS td FROM c WINDOW w AS (PARTITION BY key, level ORDER BY _time, seq))
SELECT key, fn, level, seq, _time FROM t WHERE d = -1 AND (tf <> fn OR td <> 1)""")
def call_nesting_errors(spark, sf):
    return ca.nesting_errors(rows(spark, sf))


@query("stack_reconstruct", CALLS + """
, z AS (SELECT key, fn, d, _time, seq, level FROM c
    UNION ALL SELECT _tid, NULL, 0, _time, seq, NULL FROM e WHERE event = 'error'),
z1 AS (SELECT *, CAST(sum(d) OVER (PARTITION BY key ORDER BY _time, seq) AS BIGINT) AS depth FROM z),
z2 AS (SELECT key, seq, _time, d, lv, NULL AS entered FROM z1, unnest(range(1, depth + 1)) AS u(lv)
       WHERE d = 0 AND depth > 0
    UNION ALL SELECT key, seq, _time, d, level, fn FROM z1 WHERE d = 1),
z3 AS (SELECT *, last_value(entered IGNORE NULLS) OVER (PARTITION BY key, lv ORDER BY _time, seq
    ROWS UNBOUNDED PRECEDING) AS frame FROM z2),
z4 AS (SELECT key, seq, string_agg(frame, ';' ORDER BY lv) AS stack FROM z3 WHERE d = 0 GROUP BY key, seq)
SELECT _tid AS key, e.seq AS sample_id, coalesce(stack, '') AS stack FROM e LEFT JOIN z4 ON e.seq = z4.seq
WHERE event = 'error'""")
def stack_reconstruct(spark, sf):
    found = ca.open_frames(events(spark, sf), FUNCTIONS, ["error"])
    return found.withColumn("stack", F.array_join("stack", ";"))


ANY = CALLS + """
, ent AS (SELECT key, fn, seq, _time FROM c WHERE d = 1),
sp AS (SELECT a.key, a.fn, a.seq AS s0, a._time AS t0, m.ret_time AS t1, m.ret_id AS s1 FROM ent a
    LEFT JOIN matched m ON m.key = a.key AND m.entry_id = a.seq),
en AS (SELECT e2.key, e2.fn, e2.seq, e2._time, sp.fn AS f, sp.t0, sp.s0 FROM ent e2 LEFT JOIN sp ON sp.key = e2.key
    AND (sp.t0, sp.s0) < (e2._time, e2.seq) AND (sp.t1 IS NULL OR (e2._time, e2.seq) < (sp.t1, sp.s1)))"""


@query("call_callers_any", ANY + """
SELECT key, fn, seq, _time, count(f) + 1 AS level, coalesce(arg_max(f, (t0, s0)), 'root') AS caller
FROM en GROUP BY key, fn, seq, _time""")
def call_callers_any(spark, sf):
    return ca.callers_any_nesting(rows(spark, sf))
