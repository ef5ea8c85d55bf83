"""Rows with nulls in keys and values."""
import datetime

from tracewell.operators import skew
from tracewell.operators import udfs as U
from tracewell.streaming import state as ST


def test_a_null_key_is_a_group(spark):
    df = spark.createDataFrame([("a", 2.0), (None, 4.0), (None, None), ("a", 8.0)], "k string, v double")
    assert {(r.k, round(r.geometric_mean, 6), r.n) for r in U.geometric_mean(df, "k", "v").collect()} == {("a", 4.0, 2), (None, 4.0, 1)}


def test_partial_counts_keep_events_without_a_user(spark):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, at, 1.0), (None, at, 2.0), (None, at, None), (2, at, None)], "user_id long, ts timestamp, value double")
    rows = ST.partial_counts(df.coalesce(1)).collect()
    assert {(r.user_id, r.n, r.total) for r in rows} == {(1, 1, 1.0), (None, 2, 2.0), (2, 1, None)}


def test_typed_filter_takes_signs_and_nulls(spark):
    df = spark.createDataFrame([(11,), (-13,), (12,), (None,), (0,)], "n long")
    assert {r.n for r in U.typed_filter(df, "n").collect()} == {11, -13, 0}


def test_lookup_join_takes_map_columns(spark):
    big = spark.createDataFrame([("a", {"x": 1}), ("b", {})], "k string, m map<string,int>")
    assert skew.lookup_join(big, spark.createDataFrame([("a", 5)], "k string, v int"), ["k"]).count() == 1


def test_word_rows_of_nulls_and_blanks(spark):
    spark.createDataFrame([(1, " a  bcd "), (2, None), (3, ""), (4, "  "), (5, "é"), (None, "x y")], "k long, t string").createOrReplaceTempView("texts")
    name = U.register_word_rows(spark)
    found = {tuple(r) for r in spark.sql(f"SELECT * FROM {name}(TABLE(texts))").collect()}
    assert found == {(1, 0, "a", 1), (1, 1, "bcd", 3), (5, 0, "é", 1), (None, 0, "x", 1), (None, 1, "y", 1)}
    assert spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM texts WHERE k < 0))").count() == 0
