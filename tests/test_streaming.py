"""Shapes that streams reject, restarts, and state on several deliveries."""
import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from tracewell.sources import table
from tracewell.sources.files import write_new
from tracewell.streaming import state as ST
from tracewell.streaming.runner import AppendRun, event_stream, folder_stream, latest_by_key, run_append, run_batches


def rejected(stream, mode="append"):
    with pytest.raises((AnalysisException, StreamingQueryException)):
        run_append(stream, "rejected") if mode == "append" else run_batches(stream, "rejected", mode)


def test_append_without_watermark(spark, sf_dir):
    rejected(event_stream(spark, sf_dir).groupBy("event_type").count())


def test_complete_without_aggregate(spark, sf_dir):
    rejected(event_stream(spark, sf_dir).select("event_id"), "complete")


def test_sort_outside_complete(spark, sf_dir):
    rejected(event_stream(spark, sf_dir).orderBy("event_id"))


def test_union_with_a_table(spark, sf_dir):
    batch = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rejected(event_stream(spark, sf_dir).union(batch))


def test_outer_join_without_watermark(spark, sf_dir):
    other = event_stream(spark, sf_dir).select(F.col("event_id").alias("other_id"))
    rejected(event_stream(spark, sf_dir).join(other, F.col("event_id") == F.col("other_id"), "left"))


def test_table_on_the_preserved_side(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    rejected(customers.join(event_stream(spark, sf_dir), "user_id", "left"))


def test_row_window_over_a_stream(spark, sf_dir):
    from pyspark.sql import Window as W
    rejected(event_stream(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy("ts"))))


def test_except_and_intersect(spark, sf_dir):
    users = event_stream(spark, sf_dir).select("user_id")
    rejected(users.subtract(users))
    rejected(users.intersect(users))


def test_grouping_sets_are_accepted_by_now(spark, sf_dir):
    counts = run_batches(event_stream(spark, sf_dir).cube("event_type").count(), "cube", "complete")
    assert counts.filter("event_type is null").first()["count"] == table(spark, sf_dir, "events").count()


def test_limit_in_update_mode(spark, sf_dir):
    rejected(event_stream(spark, sf_dir).limit(5), "update")


def test_watermark_needs_an_instant(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    with pytest.raises(AnalysisException):
        raw.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).count()


def test_a_second_watermark_is_refused(spark, sf_dir):
    stream = event_stream(spark, sf_dir, "2 days").withWatermark("ts", "1 hour")
    rejected(stream.groupBy(F.window("ts", "1 hour")).count())


def test_time_window_arguments(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    for size, slide, start in (("1 hour", "2 hours", "0 seconds"), ("2 hours", "1 hour", "1 hour")):
        with pytest.raises(AnalysisException):
            events.groupBy(F.window("ts", size, slide, start)).count().collect()


def test_state_goes_on_over_deliveries_and_restarts(spark):
    """Two runs on one checkpoint: totals grow, no file is read twice."""
    first = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:00:00", 2.0)], "user_id long, t string, value double")
    first = first.select("user_id", F.to_timestamp("t").alias("ts"), "value")
    landing = write_new(first, "deliveries")
    run = AppendRun(spark, "milestones")

    def go():
        return {tuple(r) for r in run.run(ST.milestones(folder_stream(spark, landing, first.schema), 2)).collect()}

    assert go() == set()
    first.union(first).write.mode("append").parquet(landing)
    assert go() == {(1, 2), (2, 2)}
    assert go() == {(1, 2), (2, 2)}


def test_running_totals_of_two_batches(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    landing = write_new(events, "totals")
    totals = latest_by_key(run_batches(ST.running_totals(folder_stream(spark, landing, events.schema)), "totals", "update"), ["user_id"])
    want = {r["user_id"]: r["n"] for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {r["user_id"]: r["n"] for r in totals.collect()} == want


def test_scripts_of_a_batch_are_dealt(spark, sf_dir, monkeypatch):
    from tracewell.streaming import event_queries
    dealt = []

    def counting(df, *args):
        dealt.append(df.count())
        return real(df, *args)

    real = event_queries.use_all_cores
    monkeypatch.setattr(event_queries, "use_all_cores", counting)
    assert event_queries.st_foreach_batch(spark, sf_dir).count() > 0
    assert len(dealt) == 2 and all(dealt)
