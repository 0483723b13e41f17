"""Aggregations, set operations, windows and event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.operators.memory import labels_of
from corpusgraph.queries.registry import query, table
from corpusgraph.streaming import windows


@query("counts_grouping_sets", "SELECT event_type, user_id % 3 AS bucket, count(*) AS n FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id % 3))")
def counts_grouping_sets(spark, d):
    rows = table(spark, d, "events").withColumn("bucket", F.col("user_id") % 3)
    return rows.groupingSets([[], ["event_type"], ["bucket"]], "event_type", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("map_topn", "SELECT source, n, names FROM (SELECT source, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(lang))), 1, 5), ',') AS names FROM documents WHERE n_chars > 1000 GROUP BY source) ORDER BY n DESC, source LIMIT 10")
def map_topn(spark, d):
    rows = table(spark, d, "documents").filter("n_chars > 1000").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("lang")), 1, 5), ",").alias("names"))
    return rows.orderBy(F.desc("n"), "source").limit(10)


@query("lang_tally", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_tally(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("mean_median", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY event_type")
def mean_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


@query("collect_set_sorted", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def collect_set_sorted(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("label_union", "SELECT doc_id, array_to_string(list_sort(list_distinct(['derived', 'repo:private', lang, source])), ',') AS labels FROM documents")
def label_union(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(labels_of(F.array("lang", "source")), ",").alias("labels"))


@query("set_intersect", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")).intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("set_except", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 30000")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).subtract(table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 30000").select("o_custkey"))


@query("rollup_revenue", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("approx_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, true AS parts_near, true AS suppliers_near FROM lineitem")
def approx_distinct(spark, d):
    # A sketch differs between engines; its standard error, set here, doesn't: four of them hold.
    error = 0.03
    near = lambda c: F.abs(F.approx_count_distinct(c, error) - F.countDistinct(c)) <= 4 * error * F.countDistinct(c)
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), near("l_partkey").alias("parts_near"), near("l_suppkey").alias("suppliers_near"))


@query("window_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean4 FROM events")
def window_moving_avg(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean4"))


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 80")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(80)


@query("events_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return windows.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("started", "yyyy-MM-dd").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sliding", "SELECT strftime(started, '%Y-%m-%d') AS started, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS started FROM events) GROUP BY ALL")
def events_sliding(spark, d):
    return windows.sliding(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("started", "yyyy-MM-dd").alias("started"), "n")


SESSIONS_SQL = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n FROM s GROUP BY user_id, k"""


@query("events_session", SESSIONS_SQL)
def events_session(spark, d):
    return windows.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.unix_micros("started").alias("started_us"), "n")
