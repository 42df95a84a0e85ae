"""The SQL surface over event tables: users write Spark SQL, event frames are the tables."""

from __future__ import annotations

from ..functions.text import glob_regex
from ..sources.events import event_metadata
from .registry import E, HOUR, META, events, query, table


def both(name: str, text: str, spark_text: str | None = None) -> None:
    """Register a statement that reads the same in both engines (over ``{e}``, the events frame)."""
    @query(name, E + " " + text.format(e="e", hour=HOUR, idiv="//"))
    def run(spark, sf):
        return spark.sql((spark_text or text).replace("{idiv}", "div").replace("{hour}", f"{HOUR}L"), e=events(spark, sf))


both("sql_count", "SELECT count(*) AS n FROM {e}")
both("sql_group", "SELECT event, _cpu, count(*) AS n FROM {e} GROUP BY event, _cpu")
both("sql_stats", """SELECT event, CAST(sum(num) AS BIGINT) AS total, min(num) AS low, max(num) AS high,
  CAST(sum(num) AS DOUBLE) / count(*) AS mean FROM {e} GROUP BY event""")
both("sql_count_distinct", "SELECT event, count(DISTINCT _pid) AS pids, count(DISTINCT k) AS ks FROM {e} GROUP BY event")
both("sql_having", "SELECT _pid, count(*) AS n FROM {e} GROUP BY _pid HAVING count(*) > 70")
both("sql_topk", "SELECT _pid, event, count(*) AS n FROM {e} GROUP BY _pid, event ORDER BY n DESC, _pid, event LIMIT 20")
both("sql_where", """SELECT seq, event, k FROM {e}
WHERE (event = 'view' AND k >= 90) OR (event <> 'view' AND k < 5 AND _cpu != 3)""")
both("sql_glob", "SELECT seq, event FROM {e} WHERE event GLOB '[p-v]?[!r]*'",
     f"SELECT seq, event FROM {{e}} WHERE event RLIKE r'{glob_regex('[p-v]?[!r]*')}'")
both("sql_union", "SELECT _pid, _cpu FROM {e} WHERE event = 'view' UNION SELECT _pid, _cpu FROM {e} WHERE event = 'click'")
both("sql_union_all", """SELECT 'v' AS src, _pid, k FROM {e} WHERE event = 'view' AND k < 20
UNION ALL SELECT 'c', _pid, k FROM {e} WHERE event = 'click' AND k < 20""")
both("sql_time_bucket", """SELECT _time {idiv} {hour} AS bucket, event, count(*) AS n, CAST(sum(num) AS BIGINT) AS total
FROM {e} GROUP BY 1, 2""")
both("sql_exprs", """SELECT seq, num * 2 + k AS x, CASE WHEN k > 50 THEN 'hi' ELSE 'lo' END AS level, 'lit' AS tag,
  CAST(k AS BIGINT) * num AS prod FROM {e}""")
both("sql_group_bare", """SELECT _pid, min(event) AS event, min(_cpu) AS _cpu, count(*) AS n FROM {e} GROUP BY _pid""")


@query("sql_join", """
SELECT c_mktsegment, o_orderpriority, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY c_mktsegment, o_orderpriority""")
def sql_join(spark, sf):
    return spark.sql("""
        SELECT c_mktsegment, o_orderpriority, count(*) AS n, sum(l_partkey) AS parts
        FROM {l} JOIN {o} ON l_orderkey = o_orderkey JOIN {c} ON o_custkey = c_custkey
        WHERE o_orderstatus = 'F' GROUP BY c_mktsegment, o_orderpriority""",
                     l=table(spark, sf, "lineitem"), o=table(spark, sf, "orders"), c=table(spark, sf, "customer"))


@query("sql_join_meta", META + """
SELECT e.event, _cpu, count(*) AS n, max(sample_count) AS samples FROM e JOIN m ON e.event = m.table_name
WHERE _time - first_sample_time < 86400000000000 GROUP BY e.event, _cpu""")
def sql_join_meta(spark, sf):
    e = events(spark, sf)
    return spark.sql("""
        SELECT e.event, _cpu, count(*) AS n, max(sample_count) AS samples
        FROM {e} e JOIN {m} m ON e.event = m.table_name
        WHERE _time - first_sample_time < 86400000000000 GROUP BY e.event, _cpu""", e=e, m=event_metadata(e))


@query("sql_percentile", E + """
SELECT event, CAST(quantile_disc(num, 0.5) AS BIGINT) AS mid, CAST(quantile_disc(num, 0.9) AS BIGINT) AS p90,
  CAST(min(num) AS BIGINT) AS low FROM e GROUP BY event""")
def sql_percentile(spark, sf):
    from ..functions.quantiles import distribution
    return distribution(events(spark, sf), ["event"], "num", {"mid": "0.5", "p90": "0.9"}).selectExpr(
        "event", "mid", "p90", "min AS low")
