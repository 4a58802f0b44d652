"""Queries of histograms, speed curves, change columns and label numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.operators import spikes as S, summaries as SM, tracking as T
from spikegrid.plans.base import R, all_units, compose, options, query, rd, table, tracking

_PRICE = SM.even_edges(0.0, 500_000.0, bins=40)
_QUANTITY, _DISCOUNT = [1.0, 5.0, 12.5, 30.0, 50.0], SM.even_edges(0.0, 0.1, width=0.025)


def _bin(value: str, edges: list[float]) -> str:
    """The bin as a sum of comparisons, the last edge included."""
    steps = " + ".join(f"CAST({value} >= {e!r} AS INTEGER)" for e in edges[1:-1]) or "0"
    return f"CASE WHEN {value} >= {edges[0]!r} AND {value} <= {edges[-1]!r} THEN {steps} END"


@query("price_histogram", f"""
SELECT * FROM (SELECT o_orderpriority, {_bin('CAST(o_totalprice AS DOUBLE)', _PRICE)} AS x_bin, count(*) AS n FROM orders GROUP BY 1, 2) WHERE x_bin IS NOT NULL""")
def price_histogram(spark, sf):
    return SM.histogram(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", _PRICE)


@query("two_way_histogram", f"""
SELECT * FROM (SELECT {_bin('CAST(l_quantity AS DOUBLE)', _QUANTITY)} AS x_bin, {_bin('CAST(l_discount AS DOUBLE)', _DISCOUNT)} AS y_bin, count(*) AS n
FROM lineitem GROUP BY 1, 2) WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL""")
def two_way_histogram(spark, sf):
    return SM.histogram(table(spark, sf, "lineitem"), [], "l_quantity", _QUANTITY, "l_discount", _DISCOUNT)


@query("rate_by_speed", compose(f"""
, n AS (SELECT session_id, floor(t / 43200.0) AS bin, count(*) / 43200.0 AS rate FROM ev GROUP BY 1, 2),
s AS (SELECT session_id, floor(t / 43200.0) AS bin, avg(speed * 100000) AS speed FROM speed GROUP BY 1, 2)
SELECT CAST(trunc(speed) AS BIGINT) AS speed, {R('avg(rate)', 8)} AS mean_rate, {R('max(rate)', 8)} AS max_rate, count(*) AS intervals
FROM n JOIN s USING (session_id, bin) WHERE speed IS NOT NULL GROUP BY 1""", "speed"))
def rate_by_speed(spark, sf):
    u = all_units(spark, sf).select("session_id", F.lit("all").alias("unit"), "i", "t")
    rates = S.interval_rate(u, 43_200.0)
    trk = T.with_speed(tracking(spark, sf), options(spark, sf)).withColumn("speed", F.col("speed") * 100_000)
    out = SM.rate_by_speed(rates, S.interval_speed(trk, 43_200.0))
    return out.select("speed", rd("mean_rate", 8).alias("mean_rate"), rd("max_rate", 8).alias("max_rate"), "intervals")


# a customer's orders stand in for the sessions of a cell
_PAIRS = """pairs AS (SELECT c_nationkey AS site, o_orderkey, lag(o_totalprice) OVER w AS p, o_totalprice AS c
  FROM orders JOIN customer ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def _order_pairs(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site")), "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = o.select("site", "o_orderkey", F.lag("o_totalprice").over(w).cast("double").alias("price_prev"), F.col("o_totalprice").cast("double").alias("price_curr"))
    return p.where("price_prev IS NOT NULL")


@query("change_columns", f"""
WITH {_PAIRS} SELECT o_orderkey, CAST(p AS DOUBLE) AS before, CAST(c AS DOUBLE) AS after, {R('CAST(c AS DOUBLE) - CAST(p AS DOUBLE)', 2)} AS difference FROM pairs WHERE p IS NOT NULL""")
def change_columns(spark, sf):
    d = SM.with_change(_order_pairs(spark, sf), ["price"])
    return d.select("o_orderkey", F.col("price")[0].alias("before"), F.col("price")[1].alias("after"), rd(F.col("price")[2], 2).alias("difference"))


@query("change_z", f"""
WITH {_PAIRS}, v AS (SELECT site, o_orderkey, c / p AS ratio, CAST(c AS DOUBLE) - CAST(p AS DOUBLE) AS change FROM pairs WHERE p IS NOT NULL),
m AS (SELECT site, avg(ratio) ra, stddev_pop(ratio) rs, avg(change) ca, stddev_pop(change) cs FROM v GROUP BY 1)
SELECT o_orderkey, {R('CASE WHEN rs <> 0 THEN (ratio - ra) / rs END')} AS ratio_z, {R('CASE WHEN cs <> 0 THEN (change - ca) / cs END')} AS change_z FROM v JOIN m USING (site)""")
def change_z(spark, sf):
    p = _order_pairs(spark, sf)
    v = p.select("site", "o_orderkey", (F.col("price_curr") / F.col("price_prev")).alias("ratio"), (F.col("price_curr") - F.col("price_prev")).alias("change"))
    s = SM.change_scores(v, v, ["site"], ["ratio", "change"])
    return s.select("o_orderkey", rd("ratio_z").alias("ratio_z"), rd("change_z").alias("change_z"))


# parts of a supplier stand in for units, lines of one order pair up
_MATCH = """m AS (SELECT l_suppkey AS site, l_partkey AS unit_a, max(l_partkey + l_linenumber) AS unit_b, min(l_extendedprice) AS distance
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
u AS (SELECT DISTINCT l_suppkey AS site, l_partkey AS label FROM lineitem)"""


def _matches(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    m = li.where("l_returnflag = 'R'").groupBy("site", F.col("l_partkey").alias("unit_a")).agg(
        F.max(F.col("l_partkey") + F.col("l_linenumber")).alias("unit_b"), F.min("l_extendedprice").alias("distance"))
    return m, li.select("site", F.col("l_partkey").alias("label")).distinct()


def _numbering(kept: str, new: str) -> str:
    return f"""WITH {_MATCH}, t AS (SELECT site, {kept} AS label, {new} AS new_label FROM m),
top AS (SELECT site, max(new_label) AS top FROM t GROUP BY 1),
r AS (SELECT u.site, u.label, row_number() OVER (PARTITION BY u.site ORDER BY u.label) AS k FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.site = u.site AND m.{kept} = u.label))
SELECT site, label, CAST(new_label AS BIGINT) AS new_label FROM t UNION ALL
SELECT site, label, CAST(coalesce(top, 0) + 1 + k AS BIGINT) FROM r LEFT JOIN top USING (site)"""


@query("sequential_labels", _numbering("unit_b", "unit_a"))
def sequential_labels(spark, sf):
    m, u = _matches(spark, sf)
    left = u.join(m.select("site", F.col("unit_b").alias("label")), ["site", "label"], "left_anti")
    return SM.sequential_labels(m, left, ["site"]).select("site", "label", F.col("new_label").cast("long").alias("new_label"))


@query("first_session_labels", _numbering("unit_a", "row_number() OVER (PARTITION BY site ORDER BY distance, unit_a)"))
def first_session_labels(spark, sf):
    m, u = _matches(spark, sf)
    left = u.join(m.select("site", F.col("unit_a").alias("label")), ["site", "label"], "left_anti")
    return SM.first_session_labels(m, left, ["site"]).select("site", "label", F.col("new_label").cast("long").alias("new_label"))


@query("largest_label", "SELECT l_suppkey AS site, max(l_partkey) AS label FROM lineitem GROUP BY 1")
def largest_label(spark, sf):
    return SM.largest_label(_matches(spark, sf)[1], ["site"])
