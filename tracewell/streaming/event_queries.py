"""Streaming queries over the events; results equal the batch query they are checked against."""
from pyspark.sql import functions as F

from tracewell.operators import graph as G
from tracewell.operators import scripts as S
from tracewell.operators import statements as T
from tracewell.registry import query
from tracewell.sources import table, use_all_cores
from tracewell.sources.files import write_new
from tracewell.storage import scratch_path
from tracewell.streaming import state as ST
from tracewell.streaming.runner import (
    AppendRun, event_stream, folder_stream, last_batch, latest_by_key, run_append, run_batches, run_foreach, table_stream)

from tracewell.plans.table_lineage import STMTS, jobs_of

TEXT = "yyyy-MM-dd HH:mm:ss"


def bounds(df):
    """Window bounds as text."""
    return df.withColumn("started", F.date_format("window.start", TEXT)).withColumn("ended", F.date_format("window.end", TEXT)).drop("window")


@query("win_time_tumbling", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL
""")
def win_time_tumbling(spark, d):
    counted = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return bounds(counted)


@query("win_time_sliding", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS started, strftime(w + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM (
  SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 15 MINUTE), time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 15 MINUTE) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL
""")
def win_time_sliding(spark, d):
    return bounds(table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour", "15 minutes")).agg(F.count(F.lit(1)).alias("n")))


@query("st_select_filter", "SELECT event_id, upper(event_type) AS kind, round(value * 2, 4) AS twice FROM events WHERE value > 10 AND event_type <> 'view'")
def st_select_filter(spark, d):
    stream = event_stream(spark, d).filter("value > 10 AND event_type <> 'view'")
    return run_append(stream.select("event_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 2, 4).alias("twice")), "select")


CLOSED = """
WITH w AS (SELECT time_bucket(INTERVAL {size}, ts) AS s, {keys}count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS started, strftime(s + INTERVAL {size}, '%Y-%m-%d %H:%M:%S') AS ended, {keys}n FROM w WHERE s + INTERVAL {size} <= (SELECT max(ts) - INTERVAL {delay} FROM events)
"""


@query("st_watermark", CLOSED.format(size="1 HOUR", keys="", delay="6 HOUR"))
def st_watermark(spark, d):
    """Windows leave once the watermark has passed them."""
    stream = event_stream(spark, d, "6 hours")
    return bounds(run_append(stream.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")), "watermark"))


@query("st_agg_append", CLOSED.format(size="1 DAY", keys="event_type, ", delay="1 DAY"))
def st_agg_append(spark, d):
    stream = event_stream(spark, d, "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return bounds(run_append(stream, "agg-append"))


@query("st_agg_update", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, max(value) AS top FROM events GROUP BY 1")
def st_agg_update(spark, d):
    stream = event_stream(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("top"))
    return latest_by_key(run_batches(stream, "agg-update", "update"), ["user_id"])


@query("st_agg_complete", "SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1")
def st_agg_complete(spark, d):
    stream = event_stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean")).orderBy(F.desc("n"))
    return last_batch(run_batches(stream, "agg-complete", "complete"))


@query("st_late_data", """
WITH marks AS (SELECT max(ts) - INTERVAL 6 HOUR AS w1, max(ts) + INTERVAL 18 HOUR AS w2 FROM events),
arrived AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, 0 AS late FROM events
  UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 1 DAY), 1 FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, CAST(sum(late) AS BIGINT) AS n_second FROM arrived, marks
WHERE (late = 0 OR s + INTERVAL 1 HOUR > w1) AND s + INTERVAL 1 HOUR <= w2 GROUP BY s
""")
def st_late_data(spark, d):
    """A second delivery, one day later: what lies before the watermark is dropped, the rest still counts."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("late"))
    landing = write_new(events, "late")
    run = AppendRun(spark, "late")

    def count():
        stream = folder_stream(spark, landing, events.schema).withWatermark("ts", "6 hours")
        return run.run(stream.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("n_second")))

    count()
    events.select((F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(1).alias("late")).write.mode("append").parquet(landing)
    return count().select(F.date_format("window.start", TEXT).alias("started"), "n", "n_second")


@query("st_dedup", "SELECT event_id, user_id, event_type FROM events")
def st_dedup(spark, d):
    """Everything is delivered twice; one row per event remains, bounded by the watermark."""
    twice = event_stream(spark, d).unionByName(event_stream(spark, d)).withWatermark("ts", "2 days")
    return run_append(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"), "dedup")


@query("st_dedup_key_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def st_dedup_key_time(spark, d):
    twice = event_stream(spark, d).unionByName(event_stream(spark, d)).withWatermark("ts", "2 days")
    return run_append(twice.dropDuplicates(["event_id", "ts"]).select("event_id", F.date_format("ts", TEXT).alias("at")), "dedup-time")


@query("st_join_static", "SELECT event_id, c_name, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def st_join_static(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    stream = event_stream(spark, d).filter("event_type = 'purchase'")
    return run_append(stream.join(customers, "user_id").select("event_id", "c_name", "c_mktsegment"), "join-static")


@query("st_join_static_outer", "SELECT event_id, s_name FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def st_join_static_outer(spark, d):
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_name")
    return run_append(event_stream(spark, d).join(suppliers, "user_id", "left").select("event_id", "s_name"), "join-static-outer")


SALTS = 4
PAIRS = """
SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 30 MINUTE
WHERE c.event_type = 'click' AND p.event_type = 'purchase'
"""


def clicks_and_purchases(spark, d):
    """Both sides of the stream join; clicks of a user are dealt over salts, purchases copied to each."""
    events = event_stream(spark, d, "1 hour")
    salt = F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")
    clicks = events.filter("event_type = 'click'").select(F.col("user_id").alias("u1"), salt.alias("s1"), F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    other = event_stream(spark, d, "1 hour").filter("event_type = 'purchase'")
    purchases = other.select(F.col("user_id").alias("u2"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("s2"), F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id"))
    on = F.expr("u1 = u2 AND s1 = s2 AND purchase_ts > click_ts AND purchase_ts <= click_ts + interval 30 minutes")
    return clicks, purchases, on


@query("st_join_stream_inner", PAIRS)
def st_join_stream_inner(spark, d):
    clicks, purchases, on = clicks_and_purchases(spark, d)
    return run_append(clicks.join(purchases, on).select("click_id", "purchase_id"), "join-inner")


@query("st_join_stream_outer", PAIRS + """
UNION ALL
SELECT c.event_id, NULL FROM events c WHERE c.event_type = 'click'
AND c.ts < (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 90 MINUTE FROM events)
AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 30 MINUTE)
""")
def st_join_stream_outer(spark, d):
    """Clicks without a purchase come out once the watermark rules one out."""
    clicks, purchases, on = clicks_and_purchases(spark, d)
    return run_append(clicks.join(purchases, on, "left").select("click_id", "purchase_id"), "join-outer")


@query("st_union", "SELECT event_id, 'click' AS branch FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'dear' FROM events WHERE value > 50")
def st_union(spark, d):
    clicks = event_stream(spark, d).filter("event_type = 'click'").select("event_id", F.lit("click").alias("branch"))
    dear = event_stream(spark, d).filter("value > 50").select("event_id", F.lit("dear").alias("branch"))
    return run_append(clicks.union(dear), "union")


@query("st_map_groups_state", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def st_map_groups_state(spark, d):
    batches = run_batches(ST.running_totals(event_stream(spark, d)), "map-groups", "update")
    return latest_by_key(batches, ["user_id"]).withColumn("total", F.round("total", 6))


@query("st_flatmap_groups_state", "SELECT user_id, unnest(range(10, n + 1, 10)) AS milestone FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def st_flatmap_groups_state(spark, d):
    return run_append(ST.milestones(event_stream(spark, d), 10), "flatmap-groups")


@query("st_state_timeout", """
SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 6 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def st_state_timeout(spark, d):
    """Users without an event for six hours at the end of the data."""
    return run_append(ST.silent_users(event_stream(spark, d), 6 * 3600 * 1000), "timeout").select("user_id", "n")


@query("st_foreach_batch", STMTS.rstrip() + "\nSELECT concat(src_db, '.', src_table) AS src, concat(dst_db, '.', dst_table) AS dst FROM edges", ("f_jobs",))
def st_foreach_batch(spark, d):
    """New scripts arrive twice; each batch is merged into the edge table as its next version."""
    jobs = jobs_of(spark, d)
    landing = write_new(jobs.filter("run_type = 'hive'"), "scripts")
    tables, checkpoint = scratch_path(spark, "edges"), scratch_path(spark, "edges-checkpoint")

    def version(number):
        return spark.read.schema("src string, dst string, props string").parquet(f"{tables}/version={number}")

    def upsert(batch, batch_id):
        new = G.table_name_edges(T.table_edges(T.table_refs(use_all_cores(S.scheduled_jobs(batch))))).withColumn("props", F.lit(f"batch {batch_id}"))
        merged = G.merge_edges(version(batch_id - 1), new) if batch_id else new
        merged.write.mode("overwrite").parquet(f"{tables}/version={batch_id}")

    def deliver():
        run_foreach(folder_stream(spark, landing, jobs.schema), "upsert", "append", upsert, checkpoint)

    deliver()
    jobs.filter("run_type <> 'hive'").write.mode("append").parquet(landing)
    deliver()
    deliver()  # nothing new: the edges stay as they are
    newest = spark.read.parquet(tables).agg(F.max("version")).first()[0]  # as storage has it, whoever wrote it
    return version(newest).select("src", "dst")
