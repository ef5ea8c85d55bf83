"""Window queries. Keys with very many rows are spread over tasks (operators.skew)."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators import windows as WN
from tracewell.operators.skew import attach, last_known, ranked, row_frames, running
from tracewell.registry import query
from tracewell.sources import run_sql, table

PRIORITY = ["o_orderpriority"]


def by_price(spark, d):
    """Orders ranked by price within their priority."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return WN.ranking(orders, PRIORITY, ["-o_totalprice"], ["o_orderkey"], 7)


@query("win_ranking", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)
""")
def win_ranking(spark, d):
    return by_price(spark, d).select("o_orderkey", "rn", "rk", "dr")


@query("win_distribution", """
SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, CAST(ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS nt
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)
""")
def win_distribution(spark, d):
    return by_price(spark, d).select("o_orderkey", F.round("pr", 9).alias("pr"), F.round("cd", 9).alias("cd"), "nt")


def user_events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


ORDER = ["ts", "event_id"]


@query("win_lag_lead", """
SELECT event_id, lag(event_type, 1, 'none') OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def win_lag_lead(spark, d):
    columns = {"before": ("event_type", -1, "none"), "after": ("value", 2)}
    return WN.neighbours(user_events(spark, d), ["user_id"], ORDER, columns).select("event_id", "before", "after")


@query("win_agg_running", """
SELECT event_id, round(sum(value) OVER w, 6) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def win_agg_running(spark, d):
    out = running(user_events(spark, d), ["user_id"], ORDER, {"total": F.col("value"), "n": F.lit(1)})
    return out.select("event_id", F.round("total", 6).alias("total"), "n")


@query("win_agg_rows", """
SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)
""")
def win_agg_rows(spark, d):
    out = row_frames(user_events(spark, d), ["user_id"], ORDER, 3, 1, {
        "mean": lambda w: F.avg("value").over(w.rowsBetween(-3, 1)), "top": lambda w: F.max("value").over(w.rowsBetween(-3, 1))})
    return out.select("event_id", F.round("mean", 6).alias("mean"), "top")


@query("win_agg_range", """
SELECT event_id, round(sum(value) OVER w, 6) AS total, count(*) OVER w AS n
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)
""")
def win_agg_range(spark, d):
    events = user_events(spark, d).withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    out = WN.range_frame(events, ["user_id"], "sec", 21600, 43200, {"total": F.col("value"), "n": F.lit(1)})
    return out.select("event_id", F.round("total", 6).alias("total"), "n")


@query("win_agg_whole", "SELECT event_id, round(value / sum(value) OVER (PARTITION BY event_type), 12) AS share FROM events")
def win_agg_whole(spark, d):
    return WN.share_of_total(user_events(spark, d), ["event_type"], "value", "share").select("event_id", F.round("share", 12).alias("share"))


@query("win_default_frame", """
SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS DOUBLE) AS total, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS rk FROM orders
""")
def win_default_frame(spark, d):
    """Rows of one date are peers: the default frame takes them all in, a rank its own frame."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    summed = running(orders, PRIORITY, ["o_orderdate"], {"total": F.col("o_totalprice").cast("decimal(20,2)")}, peers=True)
    return ranked(summed, PRIORITY, ["o_orderdate"]).select("o_orderkey", F.col("total").cast("double").alias("total"), "rk")


NAMED = """
SELECT event_id, row_number() OVER w AS rn, round(sum(value) OVER w, 6) AS total, first_value(event_type) OVER w AS opening
FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id)
"""


@query("win_named", NAMED.replace("row_number() OVER w", "CAST(row_number() OVER w AS INT)"))
def win_named(spark, d):
    return run_sql(spark, d, NAMED, "events")


@query("win_multi_spec", """
WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(sum(v) OVER (PARTITION BY event_type ORDER BY day), 6) AS so_far, rank() OVER (PARTITION BY day ORDER BY n DESC) AS place,
       round(v / sum(v) OVER (PARTITION BY event_type), 9) AS share FROM daily
""")
def win_multi_spec(spark, d):
    """Several windows over an aggregate: one row per type and day."""
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return daily.select(
        "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.sum("v").over(W.partitionBy("event_type").orderBy("day")), 6).alias("so_far"),
        F.rank().over(W.partitionBy("day").orderBy(F.desc("n"))).cast("bigint").alias("place"), F.round(F.col("v") / F.sum("v").over(W.partitionBy("event_type")), 9).alias("share"))


@query("win_first_last", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase,
       first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events
""")
def win_first_last(spark, d):
    events = user_events(spark, d).withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    firsts = events.groupBy("user_id").agg(F.min_by("event_type", F.struct(*ORDER)).alias("first_type"))
    carried = last_known(events, ["user_id"], ORDER, "paid", "last_purchase")
    return attach(carried, firsts, ["user_id"]).select("event_id", "last_purchase", "first_type")


@query("win_topk_group", """
SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rn AS INT) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5
""")
def win_topk_group(spark, d):
    """Spark limits every input partition to five rows per group before the shuffle."""
    w = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).filter("rn <= 5")


@query("win_time_session", """
WITH marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM marked)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n, round(sum(value), 6) AS total FROM numbered GROUP BY user_id, no
""")
def win_time_session(spark, d):
    out = WN.sessions(table(spark, d, "events"), "user_id", "ts", 30, {"total": F.col("value")})
    text = "yyyy-MM-dd HH:mm:ss"
    return out.select("user_id", F.date_format("session_start", text).alias("started"), F.date_format("session_end", text).alias("ended"), "n", F.round("total", 6).alias("total"))
