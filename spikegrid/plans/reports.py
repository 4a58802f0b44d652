"""Report and statistics queries on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spikegrid.functions.naming import NameRule, parse_name
from spikegrid.operators import reports as RP, spikes as S, statistics as ST
from spikegrid.operators.ordered import quantiles
from spikegrid.operators.scores import UNIT
from spikegrid.plans.base import OPTIONS, R, all_units, compose, events, options, part, query, rd, table


# --------------------------------------------------------------------- sessions
@query("session_order", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS session_no FROM orders""")
def session_order(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return RP.session_numbers(o, "o_custkey", ["o_orderdate", "o_orderkey"], OPTIONS).drop("o_orderdate")


@query("dedupe_prefix", """
WITH h AS (SELECT l_suppkey, l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) rn FROM lineitem) WHERE rn <= 50 GROUP BY 1, 2)
SELECT l_suppkey, min(l_orderkey) AS l_orderkey, count(*) AS copies FROM h GROUP BY l_suppkey, k""")
def dedupe_prefix(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return RP.first_of_copies(li, ["l_suppkey"], "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_quantity"], prefix=50)


@query("dedupe_trains", """
WITH h AS (SELECT l_suppkey, l_orderkey, list(l_quantity ORDER BY l_quantity) AS k FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, min(l_orderkey) AS l_orderkey, count(*) AS copies FROM h GROUP BY l_suppkey, k""")
def dedupe_trains(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity")
    return RP.first_of_copies(li, ["l_suppkey"], "l_orderkey", "l_quantity", ["l_quantity"])


@query("object_history", """
SELECT o_orderkey, lag(o_orderstatus) OVER w AS o_orderstatus_prev, lag(o_orderstatus, 2) OVER w AS o_orderstatus_prev2,
  lead(o_orderstatus) OVER w AS o_orderstatus_next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def object_history(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    h = RP.history(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", OPTIONS)
    return h.select("o_orderkey", "o_orderstatus_prev", "o_orderstatus_prev2", "o_orderstatus_next")


# names of web addresses stand in for recording file names
URL_RULES = (
    NameRule(r"^https?://m\.([^./]+)\.[^/]+/([a-z]{2})/([0-9]+)", stim=2, name=1, date=3),
    NameRule(r"^https?://www\.([^./]+)\.[^/]+/([a-z]{2})/([0-9]+)", stim=2, name=1, date=3),
    NameRule(r"^https?://([^./]+)\.[^/]+/([a-z]{2})/([0-9]+)", stim=2, name=1, date=3),
)


def _case(field: int, other: str = "NULL") -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(url, '{r.pattern}') THEN regexp_extract(url, '{r.pattern}', {field})" for r in URL_RULES) + f" ELSE {other} END"


@query("parse_names", f"""
SELECT page_id, CASE {" ".join(f"WHEN regexp_matches(url, '{r.pattern}') THEN {k}" for k, r in enumerate(URL_RULES))} END AS rule,
  {_case(1)} AS name, {_case(2)} AS stim, {_case(3)} AS number FROM pages""")
def parse_names(spark, sf):
    p = table(spark, sf, "pages").select("page_id", parse_name(F.col("url"), URL_RULES).alias("p"))
    return p.select("page_id", "p.rule", "p.name", "p.stim", F.col("p.date").alias("number"))


# ---------------------------------------------------------------------- reports
@query("report_filter", """
WITH r AS (SELECT CAST(o_orderdate AS DATE) d, o_orderpriority depth, o_custkey s, o_orderkey, o_totalprice FROM orders),
c AS (SELECT d, depth, s, count(*) cells FROM r GROUP BY 1, 2, 3),
b AS (SELECT d, depth, s FROM (SELECT *, row_number() OVER (PARTITION BY d, depth ORDER BY cells DESC, s) rn FROM c) WHERE rn = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY d) visit FROM b)
SELECT r.o_orderkey, v.visit, r.o_totalprice BETWEEN 50000 AND 300000 AS included FROM r
JOIN v ON v.d = r.d AND v.depth = r.depth AND v.s = r.s WHERE v.visit % 8 = 1""")
def report_filter(spark, sf):
    r = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("depth"), "o_custkey", "o_orderkey", "o_totalprice")
    chosen = RP.choose_sessions(r, "o_custkey", "date", "depth", OPTIONS.report_visit_step).drop("cells")
    j = r.join(chosen, ["date", "depth", "o_custkey"])
    return j.select("o_orderkey", "visit", F.col("o_totalprice").between(50_000, 300_000).alias("included"))


@query("report_union", """
SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS source FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, s_suppkey FROM supplier""")
def report_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("source"))
    return RP.stack_reports(c, s)


@query("report_rollup", f"""
SELECT r_name, n_name, c_mktsegment, count(*) AS cells, {R('avg(c_acctbal)', 8)} AS mean_balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((r_name, n_name, c_mktsegment), (r_name, n_name), ())""")
def report_rollup(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    sets = [[F.col("r_name"), F.col("n_name"), F.col("c_mktsegment")], [F.col("r_name"), F.col("n_name")], []]
    return j.groupingSets(sets, F.col("r_name"), F.col("n_name"), F.col("c_mktsegment")).agg(
        F.count(F.lit(1)).alias("cells"), rd(F.avg("c_acctbal"), 8).alias("mean_balance"))


@query("anti_old_new", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01')""")
def anti_old_new(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select("o_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("semi_significant", """
SELECT o_orderkey, o_orderpriority, EXISTS (SELECT 1 FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200) s WHERE s.l_orderkey = o_orderkey) AS significant FROM orders""")
def semi_significant(spark, sf):
    big = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 200").select("l_orderkey", F.lit(True).alias("_s"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return o.join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderpriority", F.col("_s").isNotNull().alias("significant"))


@query("pct_of_total", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, {R('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)')} AS percent FROM lineitem GROUP BY 1, 2""")
def pct_of_total(spark, sf):
    p = RP.share_of_total(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag"], ["l_linestatus"])
    return p.withColumn("percent", rd("percent"))


@query("crosstab", """
SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "F", count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "O",
  count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "P" FROM orders GROUP BY 1""")
def crosstab(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0, ["F", "O", "P"])


@query("cell_report", compose(f"""
, ms AS (SELECT session_id, unit, (t - lag(t) OVER (PARTITION BY session_id, unit ORDER BY t, i)) * 1000 AS ms FROM ev),
a AS (SELECT session_id, unit, {R('avg(ms)', 2)} AS isi_mean, {R('quantile_cont(ms, 0.5)', 4)} AS isi_median FROM ms GROUP BY 1, 2),
b AS (SELECT session_id, unit, count(*)::DOUBLE AS n FROM ev GROUP BY 1, 2)
SELECT b.session_id, b.unit, b.n, CASE WHEN b.n > 1 THEN isi_mean END AS isi_mean, CASE WHEN b.n > 1 THEN isi_median END AS isi_median
FROM b JOIN a ON a.session_id = b.session_id AND a.unit = b.unit""", "ev"))
def cell_report(spark, sf):
    """Wide report of several score frames through the long score table."""
    u = all_units(spark, sf)
    isi = S.isi_statistics(u, options(spark, sf)).select(*UNIT, rd("isi_mean", 2).alias("isi_mean"), rd("isi_median", 4).alias("isi_median"))
    scores = RP.score_table({"rate": S.event_rate(u).select(*UNIT, "n"), "isi": isi}, UNIT)
    return RP.wide_report(scores, UNIT, ["n", "isi_mean", "isi_median"])


# ------------------------------------------------------------------- statistics
def _li(spark, sf, *cols):
    return table(spark, sf, "lineitem").select("l_returnflag", *cols)


def _returned():
    return F.col("l_returnflag") == "R"


part("lm", (), """
  SELECT count(*) FILTER (l_returnflag = 'R')::DOUBLE na, count(*) FILTER (l_returnflag <> 'R')::DOUBLE nb,
    avg(l_extendedprice) FILTER (l_returnflag = 'R') ma, avg(l_extendedprice) FILTER (l_returnflag <> 'R') mb,
    var_samp(l_extendedprice) FILTER (l_returnflag = 'R') va, var_samp(l_extendedprice) FILTER (l_returnflag <> 'R') vb FROM lineitem""")


@query("welch_t", compose(f"""
SELECT {R('ma')} AS mean_a, {R('mb')} AS mean_b, {R('(ma - mb) / sqrt(va/na + vb/nb)', 6)} AS t,
  {R('pow(va/na + vb/nb, 2) / (pow(va/na, 2)/(na-1) + pow(vb/nb, 2)/(nb-1))', 2)} AS dof FROM lm""", "lm"))
def welch_t(spark, sf):
    w = ST.welch_t(_li(spark, sf, "l_extendedprice"), "l_extendedprice", _returned())
    return w.select(rd("mean_a").alias("mean_a"), rd("mean_b").alias("mean_b"), rd("t", 6).alias("t"), rd("dof", 2).alias("dof"))


@query("one_sample_t", f"""
SELECT l_returnflag, count(*) AS n, {R('avg(l_discount)', 6)} AS mean, {R('(avg(l_discount) - 0.05) / (stddev_samp(l_discount) / sqrt(count(*)))', 4)} AS t FROM lineitem GROUP BY 1""")
def one_sample_t(spark, sf):
    t = ST.one_sample_t(_li(spark, sf, "l_discount"), F.col("l_discount"), 0.05, ["l_returnflag"])
    return t.select("l_returnflag", "n", rd("mean", 6).alias("mean"), rd("t").alias("t"))


@query("mann_whitney_u", f"""
WITH r AS (SELECT l_returnflag, l_extendedprice v, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS rk FROM lineitem),
m AS (SELECT count(*) FILTER (l_returnflag = 'R') n_a, count(*) FILTER (l_returnflag <> 'R') n_b, sum(rk) FILTER (l_returnflag = 'R') ra FROM r),
t AS (SELECT sum(c*c*c - c) tie FROM (SELECT count(*)::DOUBLE c FROM r GROUP BY v))
SELECT n_a, n_b, {R('ra - n_a::DOUBLE * (n_a + 1) / 2', 1)} AS u,
  {R('(ra - n_a::DOUBLE * (n_a + 1) / 2 - n_a::DOUBLE * n_b / 2) / sqrt(n_a::DOUBLE * n_b / 12 * ((n_a + n_b + 1) - tie / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1))))', 6)} AS z FROM m, t""")
def mann_whitney_u(spark, sf):
    m = ST.mann_whitney(_li(spark, sf, "l_extendedprice"), "l_extendedprice", _returned(), settings=OPTIONS)
    return m.select("n_a", "n_b", rd("u", 1).alias("u"), rd("z", 6).alias("z"))


@query("wilcoxon", """
WITH d AS (SELECT l_returnflag, l_quantity - 25 AS d FROM lineitem WHERE l_quantity <> 25),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d)
SELECT l_returnflag, count(*) AS n, sum(rk) FILTER (d > 0) AS w_plus, sum(rk) FILTER (d < 0) AS w_minus FROM r GROUP BY 1""")
def wilcoxon(spark, sf):
    return ST.wilcoxon(_li(spark, sf, "l_quantity"), F.col("l_quantity") - 25, ["l_returnflag"], OPTIONS).select("l_returnflag", "n", "w_plus", "w_minus")


# p values by Simpson's rule over the densities
_HALF_AREA = "(SELECT sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {density}) * abs(v) / 4000 / 3 FROM range(4001) s(k))"
_T_AREA = _HALF_AREA.format(density="exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * pow(1 + pow(k * abs(v) / 4000, 2) / dof, -(dof + 1) / 2)")
_Z_AREA = _HALF_AREA.format(density="exp(-0.5 * pow(k * abs(v) / 4000, 2)) / sqrt(2 * pi())")


@query("test_p_values", f"""
WITH l AS (SELECT *, l_extendedprice AS x, l_returnflag = 'R' AS a FROM lineitem WHERE l_linenumber = 1),
w AS (SELECT sum(w) FILTER (a) na, sum(w) FILTER (NOT a) nb, sum(w * x) FILTER (a) sa, sum(w * x) FILTER (NOT a) sb, sum(w * x * x) FILTER (a) qa, sum(w * x * x) FILTER (NOT a) qb, kind
  FROM (SELECT a, x, 1.0::DOUBLE AS w, 'welch' AS kind FROM l UNION ALL SELECT a, x, l_quantity, 'welch_weighted' FROM l) GROUP BY kind),
e AS (SELECT kind, sa / na AS ma, sb / nb AS mb, (qa - sa * sa / na) / (na - 1) / na AS ea, (qb - sb * sb / nb) / (nb - 1) / nb AS eb, na, nb FROM w),
t AS (SELECT kind, (ma - mb) / sqrt(ea + eb) AS v, pow(ea + eb, 2) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS dof FROM e
  UNION ALL SELECT 'one_sample', (avg(l_discount) - 0.0502) / (stddev_samp(l_discount) / sqrt(count(*))), count(*) - 1 FROM l
  UNION ALL SELECT 'paired', avg(l_discount - l_tax - 0.0101) / (stddev_samp(l_discount - l_tax - 0.0101) / sqrt(count(*))), count(*) - 1 FROM l),
p AS (SELECT kind, v, 1 - 2 * {_T_AREA} AS p FROM t),
r AS (SELECT a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk FROM l),
mw AS (SELECT count(*) FILTER (a)::DOUBLE na, count(*) FILTER (NOT a)::DOUBLE nb, sum(rk) FILTER (a) ra, (SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE c FROM l GROUP BY x)) tie FROM r),
d AS (SELECT l_quantity - 25.3 AS d FROM l),
dr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d),
wx AS (SELECT count(*)::DOUBLE n, sum(rk) FILTER (d > 0) wp, (SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE c FROM d GROUP BY abs(d))) tie FROM dr),
z AS (SELECT 'mann_whitney' AS kind, (ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - tie / ((na + nb) * (na + nb - 1)))) AS v FROM mw
  UNION ALL SELECT 'wilcoxon', (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) FROM wx)
SELECT kind AS test, {R('v', 5)} AS statistic, {R('p', 5)} AS p_value FROM p
UNION ALL SELECT kind || '_greater', {R('v', 5)}, {R('CASE WHEN v > 0 THEN p / 2 ELSE 1 - p / 2 END', 5)} FROM p WHERE kind IN ('welch', 'one_sample')
UNION ALL SELECT kind, {R('v', 5)}, {R(f'1 - 2 * {_Z_AREA}', 5)} FROM z""")
def test_p_values(spark, sf):
    """Statistics and p values of the two-sample, one-sample, paired and rank tests over the first line of every order."""
    l = table(spark, sf, "lineitem").where("l_linenumber = 1").select("l_extendedprice", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    sides = (l, "l_extendedprice", _returned())
    found = {
        "welch": ST.welch_t(*sides), "welch_weighted": ST.welch_t(*sides, weight=F.col("l_quantity")), "welch_greater": ST.welch_t(*sides, alternative="greater"),
        "one_sample": ST.one_sample_t(l, F.col("l_discount"), 0.0502), "one_sample_greater": ST.one_sample_t(l, F.col("l_discount"), 0.0502, alternative="greater"),
        "paired": ST.one_sample_t(l, F.col("l_discount") - F.col("l_tax"), 0.0101),
        "mann_whitney": ST.mann_whitney(*sides, settings=OPTIONS), "wilcoxon": ST.wilcoxon(l, F.col("l_quantity") - 25.3, settings=OPTIONS)}
    rows = [d.select(F.lit(k).alias("test"), rd("z" if "z" in d.columns else "t", 5).alias("statistic"), rd("p_value", 5).alias("p_value")) for k, d in found.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("weighted_ks", f"""
WITH c AS (SELECT l_extendedprice v, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) wa, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) wb FROM lineitem GROUP BY 1)
SELECT {R('max(abs(a - b))', 8)} AS d FROM (SELECT sum(wa) OVER (ORDER BY v) / sum(wa) OVER () a, sum(wb) OVER (ORDER BY v) / sum(wb) OVER () b FROM c)""")
def weighted_ks(spark, sf):
    k = ST.weighted_ks(_li(spark, sf, "l_extendedprice", "l_quantity"), "l_extendedprice", _returned(), F.col("l_quantity"), settings=OPTIONS)
    return k.select(rd("d", 8).alias("d"))


@query("bh_correction", f"""
WITH p AS (SELECT o_orderkey, o_orderpriority, o_totalprice / 1000000.0::DOUBLE AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey) rk, count(*) OVER (PARTITION BY o_orderpriority) m FROM p)
SELECT o_orderkey, {R('min(least(p * m / rk, 1.0)) OVER (PARTITION BY o_orderpriority ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 8)} AS p_adjusted FROM r""")
def bh_correction(spark, sf):
    p = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / F.lit(1_000_000.0)).alias("p"))
    b = ST.benjamini_hochberg(p, "p", ["o_orderpriority"], ["o_orderkey"], OPTIONS)
    return b.select("o_orderkey", rd("p_adjusted", 8).alias("p_adjusted"))


@query("fisher_exact", """
SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS a, count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 25) AS b,
  count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS c, count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25) AS d FROM lineitem GROUP BY 1""")
def fisher_table(spark, sf):
    f = ST.fisher(_li(spark, sf, "l_quantity", "l_linestatus"), _returned(), F.col("l_quantity") > 25, ["l_linestatus"])
    return f.drop("p_value")


@query("fisher_p", f"""
WITH t AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS a, count(*) FILTER (l_returnflag = 'R') AS r,
  count(*) FILTER (l_quantity > 25) AS s, count(*) AS n FROM lineitem GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, r + s - n), least(r, s) + 1)) AS k FROM t),
p AS (SELECT l_linestatus, k = a AS seen, lgamma(s + 1) - lgamma(k + 1) - lgamma(s - k + 1) + lgamma(n - s + 1) - lgamma(r - k + 1) - lgamma(n - s - r + k + 1)
  - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1) AS lp FROM k),
o AS (SELECT l_linestatus, lp AS limit_lp FROM p WHERE seen)
SELECT l_linestatus, {R('least(1, sum(exp(lp)) FILTER (lp <= limit_lp + 1e-7))', 6)} AS p_value FROM p JOIN o USING (l_linestatus) GROUP BY 1""")
def fisher_p(spark, sf):
    f = ST.fisher(_li(spark, sf, "l_quantity", "l_linestatus"), _returned(), F.col("l_quantity") > 25, ["l_linestatus"])
    return f.select("l_linestatus", rd("p_value", 6).alias("p_value"))


@query("linear_fit", f"""
SELECT l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)')} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
  {R('regr_r2(l_extendedprice, l_quantity)', 6)} AS r2 FROM lineitem GROUP BY 1""")
def linear_fit(spark, sf):
    f = ST.linear_fit(_li(spark, sf, "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return f.select("l_returnflag", rd("slope").alias("slope"), rd("intercept").alias("intercept"), rd("r2", 6).alias("r2"))


@query("circular_mae", f"""
SELECT event_type, {R("avg(abs(degrees(atan2(sin(radians(value) - radians(3.6 * CAST(json_extract_string(props, '$.k') AS DOUBLE))), cos(radians(value) - radians(3.6 * CAST(json_extract_string(props, '$.k') AS DOUBLE)))))))")} AS mae FROM events GROUP BY 1""")
def circular_mae(spark, sf):
    return ST.circular_mae(events(spark, sf).withColumnRenamed("unit", "event_type"), F.col("x"), 3.6 * F.col("y"), ["event_type"]).withColumn("mae", rd("mae"))


@query("value_quantiles", f"""
SELECT l_returnflag, {R('quantile_cont(l_extendedprice, 0.25)')} AS q25, {R('quantile_cont(l_extendedprice, 0.5)')} AS q50, {R('quantile_cont(l_extendedprice, 0.75)')} AS q75 FROM lineitem GROUP BY 1""")
def value_quantiles(spark, sf):
    q = quantiles(_li(spark, sf, "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, OPTIONS)
    return q.select("l_returnflag", *[rd(c).alias(c) for c in ("q25", "q50", "q75")])
