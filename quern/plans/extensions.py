"""Queries over the star schema that Spark offers beyond the assistant's own: grouping sets, set operations, ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.plans.registry import query
from quern.session import table


@query("x01_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x01(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("x02_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x02(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("x03_setops", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def x03(spark, d):
    c, s, o = (table(spark, d, t) for t in ("customer", "supplier", "orders"))
    nations, own = c.select("c_nationkey"), s.select("s_nationkey")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(nations.intersect(own), "both").union(count(c.select("c_custkey").subtract(o.select("o_custkey")), "customers")).union(count(nations.union(own).distinct(), "all"))


@query("x04_approx")
def x04(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


@query("x05_range_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal AND s_acctbal + 20")
def x05(spark, d):
    spans = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return R.range_join(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value")), spans, 20.0).select("c_custkey", "s_suppkey")


@query("x06_as_of_join", """SELECT p.event_id, p.user_id, c.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def x06(spark, d):
    e = table(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.as_of_join(buys, e.where("event_type = 'click'").select("user_id", "ts", "value"), "user_id", "ts", "value").drop("ts")


@query("x07_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(quantile_cont(o_totalprice, 0.9), 2) AS p90, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def x07(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.5), 2).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 2).alias("p90"), F.count_distinct("o_custkey").alias("customers"))


@query("x08_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def x08(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("x09_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
 JOIN region ON r_regionkey = n_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")
def x09(spark, d):
    c, o, l, n, r = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation", "region"))
    first = F.broadcast(r.orderBy("r_name").limit(1))  # one row
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(first, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name")
    paid = o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(own, "c_custkey").join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    return paid.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("x10_top_orders_per_customer", "SELECT o_custkey, o_orderkey, pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders) WHERE pos <= 3")
def x10(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("pos")).where("pos <= 3")
