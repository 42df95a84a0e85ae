"""Stacks and flame graphs over orders: region, nation, segment, priority are the frames from root to leaf."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stacks as sk
from ..operators.enrich import asof_name, symbolize
from ..operators.frames import KERNEL, KERNEL_DSO, USER, stack_frames
from ..schema import epoch_ns
from .registry import E, events, query, table

O = """WITH o AS (SELECT o_orderkey, r_name, n_name, c_mktsegment, o_orderpriority, epoch_us(o_orderdate) * 1000 AS _time,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus,
  concat_ws(';', r_name, n_name, c_mktsegment, o_orderpriority) AS path
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def orders(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    o = o.join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    o = o.join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return o.select("o_orderkey", "o_orderstatus", epoch_ns("o_orderdate").alias("_time"),
                    F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
                    F.array("r_name", "n_name", "c_mktsegment", "o_orderpriority").alias("frames"))


def joined(df, column="frames"):
    return df.withColumn(column, F.array_join(column, ";"))


@query("stack_counts", O + " SELECT path AS frames, count(*) AS n, CAST(sum(cents) AS BIGINT) AS value FROM o GROUP BY path")
def stack_counts(spark, sf):
    return joined(sk.stack_counts(orders(spark, sf), "frames", value="cents"))


@query("stack_topn", O + """
SELECT path AS frames, count(*) AS n, CAST(sum(cents) AS BIGINT) AS value FROM o GROUP BY path
ORDER BY value DESC, n DESC, r_name_order LIMIT 25""".replace(", r_name_order", ""))
def stack_topn(spark, sf):
    return joined(sk.stack_counts(orders(spark, sf), "frames", value="cents", top=25))


@query("flame_folded", O + " SELECT o_orderstatus || ';' || path AS stack, count(*) AS count FROM o GROUP BY ALL")
def flame_folded(spark, sf):
    return sk.folded(orders(spark, sf), root="o_orderstatus")


YEAR = 365 * 86_400_000_000_000


@query("flame_by_time", O + f"""
SELECT CAST(_time // {YEAR} * {YEAR} AS VARCHAR) || ';' || path AS stack, count(*) AS count FROM o GROUP BY ALL""")
def flame_by_time(spark, sf):
    return sk.folded(orders(spark, sf), bucket=YEAR)


CTX = O + """, t AS (SELECT o_orderkey, r_name AS k1, n_name AS k2, c_mktsegment AS u1, o_orderpriority AS u2 FROM o)"""


def context_stack(spark, sf):
    f = F.col("frames")
    kinds = ["kernel", "kernel", "user", "user"]
    stack = F.array(*[F.struct(F.lit(k).alias("ctx"), f[i].alias("symbol")) for i, k in enumerate(kinds)])
    return orders(spark, sf).select("o_orderkey", stack.alias("stack"))


def symbols_of(df):
    return df.withColumn("stack", F.array_join(F.transform("stack", lambda x: x["symbol"]), ";"))


@query("stack_ctx_filter", CTX + " SELECT o_orderkey, u1 || ';' || u2 AS stack FROM t")
def stack_ctx_filter(spark, sf):
    return symbols_of(sk.trim_stack(context_stack(spark, sf), ctx="user"))


@query("stack_truncate", CTX + " SELECT o_orderkey, k1 || ';' || k2 || ';' || u1 AS stack FROM t")
def stack_truncate(spark, sf):
    return symbols_of(sk.trim_stack(context_stack(spark, sf), max_depth=3))


@query("flame_tree", O + """
, l AS (SELECT 1 AS depth, r_name AS path, cents, 0 AS own FROM o
  UNION ALL SELECT 2, r_name || ';' || n_name, cents, 0 FROM o
  UNION ALL SELECT 3, r_name || ';' || n_name || ';' || c_mktsegment, cents, 0 FROM o
  UNION ALL SELECT 4, path, cents, cents FROM o)
SELECT path, depth, CAST(sum(cents) AS BIGINT) AS inclusive, CAST(sum(own) AS BIGINT) AS self FROM l GROUP BY path, depth""")
def flame_tree(spark, sf):
    return sk.flame_tree(orders(spark, sf), value="cents")


@query("flame_reversed", O + """
, l AS (SELECT 1 AS depth, o_orderpriority AS path, 0 AS own FROM o
  UNION ALL SELECT 2, o_orderpriority || ';' || c_mktsegment, 0 FROM o
  UNION ALL SELECT 3, o_orderpriority || ';' || c_mktsegment || ';' || n_name, 0 FROM o
  UNION ALL SELECT 4, o_orderpriority || ';' || c_mktsegment || ';' || n_name || ';' || r_name, 1 FROM o)
SELECT path, depth, count(*) AS inclusive, CAST(sum(own) AS BIGINT) AS self FROM l GROUP BY path, depth""")
def flame_reversed(spark, sf):
    return sk.flame_tree(orders(spark, sf), reverse=True)


def symbols(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") * 10 + 5).alias("start"), F.col("p_name").alias("name"))


@query("enr_symbol_floor", """
SELECT l_orderkey, l_linenumber, l_partkey * 10 + l_linenumber AS addr, coalesce(p_name, '??') AS symbol,
  l_partkey * 10 + l_linenumber - start AS "offset" FROM lineitem
ASOF LEFT JOIN (SELECT p_partkey * 10 + 5 AS start, p_name FROM part) s ON l_partkey * 10 + l_linenumber >= s.start""")
def enr_symbol_floor(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("addr"))
    return symbolize(rows, "addr", symbols(spark, sf))


@query("stack_symbolize", """
WITH f AS (SELECT o_orderkey, unnest([1, 2]) AS pos, unnest([o_custkey * 10, o_custkey * 10 + 7]) AS addr FROM orders),
g AS (SELECT o_orderkey, pos, CASE WHEN p_name IS NULL THEN 'Unknown' ELSE p_name || '+0x' || printf('%x', addr - start)
    END AS label FROM f
  ASOF LEFT JOIN (SELECT p_partkey * 10 + 5 AS start, p_name FROM part) s ON addr >= s.start)
SELECT o_orderkey, string_agg(label, ';' ORDER BY pos) AS frames FROM g GROUP BY o_orderkey""")
def stack_symbolize(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.expr("o_custkey * 10"), F.expr("o_custkey * 10 + 7")).alias("stack"))
    return joined(sk.symbolize_stack(rows, symbols(spark, sf))).drop("stack")


@query("enr_comm_asof", E + """
SELECT a.seq, a._pid, coalesce(name, '<...>') AS name FROM e a ASOF LEFT JOIN
  (SELECT _pid, _time, 'u' || _pid || '_' || seq AS name FROM e WHERE event = 'signup') n
  ON n._pid = a._pid AND n._time <= a._time""")
def enr_comm_asof(spark, sf):
    e = events(spark, sf)
    names = e.where("event = 'signup'").select(
        "_pid", "_time", "seq", F.concat(F.lit("u"), "_pid", F.lit("_"), "seq").alias("name"))
    return asof_name(e.select("seq", "_pid", "_time"), names).select("seq", "_pid", "name")


DAY_US = 86_400_000_000


@query("stack_frames", f"""
WITH m AS (SELECT c_custkey AS seq, c_custkey % 40 AS pid, 694224000000000000 + (c_custkey * 7919 % 2400) * {DAY_US} * 1000 AS t,
    (c_custkey * 31 % 12) * 1000 AS start, (c_custkey * 31 % 12) * 1000 + 600 + c_custkey % 7 * 300 AS "end",
    CASE WHEN c_nationkey > 1 THEN 'lib' || (c_nationkey % 5) END AS dso, c_custkey % 3 * 64 AS place FROM customer),
s AS (SELECT '{KERNEL_DSO}' AS dso, p_partkey * 10 + 5 AS start, p_name AS name FROM part
  UNION ALL SELECT 'lib' || (s_suppkey % 5), s_suppkey * 37 % 1500, s_name FROM supplier),
o AS (SELECT o_orderkey, o_custkey % 41 AS pid, epoch_us(o_orderdate) * 1000 AS t, o_custkey FROM orders),
f AS (SELECT o_orderkey, pid, t, unnest([1, 2, 4, 5]) AS pos, unnest([true, true, false, false]) AS kernel,
    unnest([o_custkey * 10, o_custkey * 10 + 7, o_custkey * 17 % 12500, o_custkey % 900]) AS addr FROM o),
u AS (SELECT f.o_orderkey, f.pos, m.dso, m.place + f.addr - m.start AS place FROM f JOIN m ON NOT kernel AND f.pid = m.pid AND m.t <= f.t
    AND f.addr >= m.start AND f.addr < m."end"
  QUALIFY row_number() OVER (PARTITION BY f.o_orderkey, f.pos ORDER BY m.t DESC, m.seq DESC) = 1),
g AS (SELECT f.*, CASE WHEN kernel THEN '{KERNEL_DSO}' ELSE u.dso END AS dso, CASE WHEN kernel THEN addr WHEN u.dso IS NOT NULL THEN u.place END AS place
  FROM f LEFT JOIN u ON f.o_orderkey = u.o_orderkey AND f.pos = u.pos),
h AS (SELECT g.*, s.start, s.name FROM g ASOF LEFT JOIN (SELECT dso, start, max(name) AS name FROM s GROUP BY dso, start) s
  ON g.dso = s.dso AND g.place >= s.start)
SELECT o_orderkey, CAST(pos - CASE WHEN pos > 2 THEN 2 ELSE 1 END AS INT) AS pos, addr, coalesce(name, 'Unknown') AS symbol,
  CASE WHEN name IS NOT NULL THEN place - start WHEN kernel THEN 0 ELSE coalesce(place, 0) END AS "offset", kernel,
  CASE WHEN kernel OR name IS NOT NULL THEN dso ELSE 'Unknown' END AS dso FROM h""")
def stack_frames_(spark, sf):
    """Kernel and user frames of orders, with mappings that change in time (those of nations 0 and 1 unmap)."""
    maps = table(spark, sf, "customer").selectExpr(
        "c_custkey AS seq", "c_custkey % 40 AS _pid", f"694224000000000000 + (c_custkey * 7919 % 2400) * {DAY_US}L * 1000 AS _time",
        "(c_custkey * 31 % 12) * 1000 AS start", "(c_custkey * 31 % 12) * 1000 + 600 + c_custkey % 7 * 300 AS end",
        "CASE WHEN c_nationkey > 1 THEN concat('lib', c_nationkey % 5) END AS dso", "c_custkey % 3 * 64 AS place")
    known = table(spark, sf, "part").selectExpr(f"'{KERNEL_DSO}' AS dso", "p_partkey * 10 + 5 AS start", "p_name AS name").unionByName(
        table(spark, sf, "supplier").selectExpr("concat('lib', s_suppkey % 5) AS dso", "s_suppkey * 37 % 1500 AS start", "s_name AS name"))
    stack = F.expr(f"array({KERNEL}L, o_custkey * 10, o_custkey * 10 + 7, {USER}L, o_custkey * 17 % 12500, o_custkey % 900)")
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 41).alias("_pid"), epoch_ns("o_orderdate").alias("_time"),
                                             F.col("o_orderkey").alias("seq"), stack.alias("stack"))
    out = stack_frames(rows, known, maps).select("o_orderkey", F.posexplode("frames").alias("pos", "f"))
    return out.select("o_orderkey", "pos", "f.*")
