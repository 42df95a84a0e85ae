"""Leaks, memory profile, live objects: purchase allocates (pointer = user), signup frees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leaks as lk
from ..operators.timeline import prev, timeline
from .pair_queries import LOST, lost_ranges
from .registry import DAY, E, EPOCH_2024, events, query, table

NOW = EPOCH_2024 + 30 * DAY

# The stack of an allocation: the user's two previous event types.
ALLOC = """
, s AS (SELECT *, coalesce(lag(event, 2) OVER w, '-') || ';' || coalesce(lag(event) OVER w, '-') AS stack FROM e
  WINDOW w AS (PARTITION BY _tid ORDER BY _time, seq)),
af AS (SELECT _tid AS ptr, _time, seq, num AS size, stack, 'u' || _cpu AS name, event = 'purchase' AS alloc FROM s
  WHERE event IN ('purchase', 'signup'))"""
LEAKS = E + ALLOC + """
, l AS (SELECT ptr, _time, seq, size, stack, name FROM
  (SELECT *, row_number() OVER (PARTITION BY ptr ORDER BY _time DESC, seq DESC) AS rn FROM af) WHERE rn = 1 AND alloc)"""


def with_stack(spark, sf):
    tl = timeline(events(spark, sf), "_tid").scan(_p=prev("event")).scan(_q=prev("_p"))
    stack = F.concat_ws(";", F.coalesce(F.col("_q._p.event"), F.lit("-")), F.coalesce(F.col("_p.event"), F.lit("-")))
    return tl.rows().withColumns({"stack": stack, "ptr": F.col("_tid"), "size": F.col("num"),
                                  "name": F.concat(F.lit("u"), F.col("_cpu"))}).drop("_p", "_q")


def leaked(spark, sf, **options):
    rows = with_stack(spark, sf)
    return lk.leaks(rows.where("event = 'purchase'"), events(spark, sf).where("event = 'signup'").withColumn("ptr", F.col("_tid")),
                    carry=("size", "stack", "name"), **options)


@query("leak_objects", LEAKS + " SELECT * FROM l")
def leak_objects(spark, sf):
    return leaked(spark, sf)


@query("leak_by_stack", LEAKS + """
SELECT stack, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM l GROUP BY stack ORDER BY bytes DESC, stack""")
def leak_by_stack(spark, sf):
    return lk.leak_report(leaked(spark, sf), sort=True)


@query("leak_by_stack_comm", LEAKS + """
, c AS (SELECT stack, name, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM l GROUP BY stack, name)
SELECT *, CAST(sum(bytes) OVER (PARTITION BY stack) AS BIGINT) AS group_bytes,
  CAST(sum(objects) OVER (PARTITION BY stack) AS BIGINT) AS group_objects FROM c""")
def leak_by_stack_comm(spark, sf):
    return lk.leak_report(leaked(spark, sf), by=("stack", "name"))


@query("leak_aged", LEAKS + f" SELECT * FROM l WHERE {NOW} - _time > {2 * DAY}")
def leak_aged(spark, sf):
    return leaked(spark, sf, older_than=2 * DAY, now=NOW)


@query("leak_stats", LEAKS + """
SELECT (SELECT count(*) FROM af WHERE alloc) AS allocs, (SELECT count(*) FROM af WHERE NOT alloc) AS frees,
  (SELECT count(*) FROM l) AS live, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM l) AS live_bytes""")
def leak_stats(spark, sf):
    e = events(spark, sf).withColumns({"ptr": F.col("_tid"), "size": F.col("num")})
    return lk.leak_totals(e.where("event = 'purchase'"), e.where("event = 'signup'"))


@query("leak_segments", E + LOST + """
SELECT ptr, _time, seq, size, segment FROM (SELECT _tid AS ptr, _time, seq, num AS size, segment, event,
  row_number() OVER (PARTITION BY _tid, segment ORDER BY _time DESC, seq DESC) AS rn FROM kept
  WHERE event IN ('purchase', 'signup')) WHERE rn = 1 AND event = 'purchase'""")
def leak_segments(spark, sf):
    e = events(spark, sf).withColumns({"ptr": F.col("_tid"), "size": F.col("num")})
    out = lk.leaks(e.where("event = 'purchase'"), e.where("event = 'signup'"), carry=("size",), lost=lost_ranges(spark))
    return out


@query("mem_profile", LEAKS + """
, p AS (SELECT lag(size) OVER w AS b, lag(stack) OVER w AS a_stack, stack AS f_stack, lag(alloc) OVER w AS pa, alloc,
    lag(_time) OVER w AS pt, _time FROM af WINDOW w AS (PARTITION BY ptr ORDER BY _time, seq)),
f AS (SELECT * FROM p WHERE NOT alloc AND pa AND pt < _time),
g AS (SELECT 'alloc' AS side, a_stack AS stack, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS objects FROM f GROUP BY ALL
    UNION ALL SELECT 'free', f_stack, CAST(sum(b) AS BIGINT), count(*) FROM f GROUP BY ALL
    UNION ALL SELECT 'unfreed', stack, CAST(sum(size) AS BIGINT), count(*) FROM l GROUP BY ALL),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY side ORDER BY bytes DESC, stack) AS INT) AS rank,
    greatest(count(*) OVER (PARTITION BY side) - 10, 0) AS skipped,
    round(bytes * 100.0::DOUBLE / sum(bytes) OVER (PARTITION BY side), 1) AS bytes_pct,
    round(objects * 100.0::DOUBLE / sum(objects) OVER (PARTITION BY side), 1) AS objects_pct FROM g)
SELECT *, 'purchase' AS alloc, CASE WHEN side <> 'unfreed' THEN 'signup' END AS free FROM h WHERE rank <= 10""")
def mem_profile(spark, sf):
    return lk.mem_profile(with_stack(spark, sf), ["purchase"], ["signup"])


@query("live_snapshot", E + """
, a AS (SELECT *, CAST(sum(CASE WHEN event IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY _tid
    ORDER BY _time, seq) AS BIGINT) AS life FROM e WHERE event IN ('purchase', 'signup', 'view')),
b AS (SELECT _tid AS obj, life, max(CAST(event = 'purchase' AS INT)) AS born, min(_time) AS created,
    bit_or(CASE WHEN event = 'view' THEN CAST(k AS BIGINT) ELSE 0 END) AS flags, count(*) - 1 AS updates FROM a GROUP BY ALL)
SELECT obj, created, flags, updates FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY life DESC) AS rn FROM b)
WHERE rn = 1 AND born = 1""")
def live_snapshot(spark, sf):
    e = events(spark, sf).where("event IN ('purchase', 'signup', 'view')").withColumns({
        "obj": F.col("_tid"), "bits": F.expr("if(event = 'view', k, 0)")})
    return lk.live_snapshot(e, "obj", F.col("event") == "purchase", F.col("event") == "signup", flags="bits")


@query("range_coalesce", """
WITH r AS (SELECT l_suppkey AS dev, l_partkey * 4 AS first, l_partkey * 4 + l_linenumber AS last, count(*) AS equal
    FROM lineitem GROUP BY ALL),
a AS (SELECT *, max(last) OVER (PARTITION BY dev ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) AS reach FROM r),
b AS (SELECT *, sum(CASE WHEN first <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY dev ORDER BY first, last
    ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT dev, min(first) AS first, max(last) AS last, CAST(sum(equal) AS BIGINT) AS merged FROM b GROUP BY dev, island""")
def range_coalesce(spark, sf):
    ranges = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS dev", "l_partkey * 4 AS first", "l_partkey * 4 + l_linenumber AS last")
    return lk.coalesce_ranges(ranges, "first", "last", by=["dev"])
