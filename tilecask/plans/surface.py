"""Relational queries that the engine has from Spark, beyond the tile cache's own operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import query, table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_regions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_brand, p_size, grouping(p_brand) AS g, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def cube_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.grouping("p_brand").cast("bigint").alias("g"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def outer_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return n.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("""SELECT o_orderkey, row_number() OVER w AS nth, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, lag(o_orderkey) OVER w AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("nth"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("recent"), F.lag("o_orderkey").over(w).alias("before"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    both = c.intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    return both.subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query("""SELECT event_id, user_id, last_purchase FROM (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'error'""")
def as_of_purchase(spark, sf_dir):
    """For each error the latest purchase of its user before it: one sort instead of a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "events").withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w))
    return rows.where("event_type = 'error'").select("event_id", "user_id", "last_purchase")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_hours(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))
    return e.groupBy("hour", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    e = table(spark, sf_dir, "events").withColumn("fresh", F.when(gap <= F.expr("interval '6' hour"), 0).otherwise(1))
    s = e.withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.count("*").alias("n")).drop("session")


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, max(length(upper(event_type)) + year(ts)) AS y FROM events GROUP BY 1")
def json_dates_strings(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.max(F.length(F.upper("event_type")) + F.year("ts")).cast("bigint").alias("y"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")
