"""Windows over a key that owns most rows must equal the plain window."""
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators import skew, windows
from tracewell.operators.aggregates import exact_percentiles, one_per_key

HOT = 50


@pytest.fixture(scope="module")
def rows(spark):
    """400 rows: one key with two thirds of them, a null key, one value shared by a third, null values."""
    rng = random.Random(7)
    data = []
    for i in range(400):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        at = 5 if rng.random() < 0.35 else rng.randrange(0, 120)
        data.append((i, key, at, rng.choice([None, float(rng.randrange(100))])))
    return spark.createDataFrame(data, "id long, k string, at long, v double").cache()


def same(left, right):
    columns = sorted(left.columns)
    a = sorted(map(repr, left.select(*columns).collect()))
    b = sorted(map(repr, right.select(*columns).collect()))
    assert a == b


def test_hot_keys_are_found(rows):
    assert [r["k"] for r in skew.hot_keys(rows, ["k"], HOT).collect()][0] == "hot"
    assert skew.hot_keys(rows, ["k"], 10_000) is None


@pytest.mark.parametrize("keys", [["k"], []])
def test_running(rows, keys):
    out = skew.running(rows, keys, ["at", "id"], {"total": F.col("v"), "n": F.lit(1)}, hot_rows=HOT)
    w = W.partitionBy(*keys).orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    same(out, rows.select("*", F.sum("v").over(w).alias("total"), F.sum(F.lit(1)).over(w).alias("n")))


@pytest.mark.parametrize("order", [["at"], ["-at"]])
def test_running_with_peers(rows, order):
    out = skew.running(rows, ["k"], order, {"total": F.col("v")}, peers=True, hot_rows=HOT)
    w = W.partitionBy("k").orderBy(*skew.ordering(order))
    same(out, rows.select("*", F.sum("v").over(w).alias("total")))


@pytest.mark.parametrize("order", [["at"], ["-at"], ["v"], ["-v"]])
def test_ranked(rows, order):
    out = skew.ranked(rows, ["k"], order, hot_rows=HOT)
    w = W.partitionBy("k").orderBy(*skew.ordering(order))
    same(out, rows.select("*", F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"),
                          F.count(F.lit(1)).over(w).alias("upto"), F.count(F.lit(1)).over(W.partitionBy("k")).alias("n")))


def test_numbered_in_descending_order(rows):
    out = skew.numbered(rows, ["k"], ["-at", "id"], hot_rows=HOT)
    same(out, rows.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(F.desc("at"), "id")).cast("bigint")))


def test_last_known(rows):
    out = skew.last_known(rows, ["k"], ["at", "id"], "v", "carried", hot_rows=HOT)
    w = W.partitionBy("k").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    same(out, rows.withColumn("carried", F.last("v", ignorenulls=True).over(w)))


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_row_frames(rows, chunk):
    make = {"before": lambda w: F.lag("id", 3).over(w), "after": lambda w: F.lead("id", 2, -1).over(w), "mean": lambda w: F.avg("v").over(w.rowsBetween(-3, 1))}
    out = skew.row_frames(rows, ["k"], ["at", "id"], 3, 2, make, chunk=chunk, hot_rows=HOT)
    w = W.partitionBy("k").orderBy("at", "id")
    same(out, rows.select("*", *[f(w).alias(n) for n, f in make.items()]))


def test_row_frame_longer_than_a_chunk_is_refused(rows):
    with pytest.raises(ValueError):
        skew.row_frames(rows, ["k"], ["id"], 10, 0, {}, chunk=10)


def test_range_frame(rows):
    out = windows.range_frame(rows, ["k"], "at", 10, 15, {"total": F.col("v"), "n": F.lit(1)})
    w = W.partitionBy("k").orderBy("at").rangeBetween(-10, 0)
    same(out, rows.select("*", F.sum("v").over(w).alias("total"), F.sum(F.lit(1)).over(w).alias("n")))


@pytest.mark.parametrize("n", [1, 3, 7, 500])
def test_ntile(rows, n):
    w = W.partitionBy("k").orderBy("at", "id")
    base = rows.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("k")))
    same(base.select("id", windows.ntile(n).alias("t")), rows.select("id", F.ntile(n).over(w).alias("t")))


def test_sessions(spark):
    """Sessions that run over midnight, several nights in a row, and exact gaps."""
    rng = random.Random(3)
    base, data = 1_704_100_000, []
    for user in range(4):
        at = base
        for _ in range(300):
            at += rng.choice([5, 61, 600, 1799, 1800, 1801, 5400])
            data.append((user, at, 1.0))
    df = spark.createDataFrame(data, "u long, s long, v double").select("u", F.timestamp_seconds("s").alias("ts"), "v")
    out = windows.sessions(df, "u", "ts", 30, {"total": F.col("v")})
    want = df.groupBy("u", F.session_window("ts", "30 minutes").alias("w")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).drop("w")
    same(out, want)


def test_lookup_join_keeps_every_row(rows, spark):
    names = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, no int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        same(skew.lookup_join(rows, names, ["k"], how), rows.join(names, "k", how))
    with pytest.raises(ValueError):
        skew.lookup_join(rows, names, ["k"], "right")


def test_exact_percentiles(rows):
    out = exact_percentiles(rows, ["k"], "v", {"p": 0.3, "top": 1.0})
    want = rows.groupBy("k").agg(F.percentile("v", 0.3).alias("p"), F.percentile("v", 1.0).alias("top"))
    def rounded(df):
        return df.select("k", F.round("p", 6).alias("p"), F.round("top", 6).alias("top"))
    same(rounded(out), rounded(want))


def test_one_per_key(rows):
    out = one_per_key(rows.select("k", "at", "id"), ["k"], [-F.col("at"), F.col("id")])
    w = W.partitionBy("k").orderBy(F.desc("at"), "id")
    same(out, rows.select("k", "at", "id").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r"))


def test_ranking_is_the_same_for_hot_keys(spark):
    from tracewell.operators import windows as WN

    df = spark.range(400).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 END AS k", "id * 37 % 23 AS v")
    native = WN.ranking(df, ["k"], ["-v"], ["id"], 5)
    hot = WN.ranking(df, ["k"], ["-v"], ["id"], 5, hot_rows=10)
    rows = lambda d: sorted((r.id, r.rn, r.rk, r.dr, round(r.pr, 9), round(r.cd, 9), r.nt) for r in d.collect())
    assert rows(native) == rows(hot)


def test_histogram_bins_are_equal(spark):
    from tracewell.operators import profiling as P

    df = spark.range(103).selectExpr("CASE WHEN id < 60 THEN 5.0D ELSE CAST(id AS DOUBLE) END AS v")
    rows = sorted(P.equi_height_histogram(df, "v", 10).collect())
    assert [r.height for r in rows] == [11, 11, 11, 10, 10, 10, 10, 10, 10, 10]
    assert (rows[0].lo, rows[4].hi, rows[5].ndv) == (5.0, 5.0, 4)


def test_salted_numbers_reach_every_row(spark):
    from tracewell.operators.skew import attach

    df = spark.range(100).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL ELSE 'a' END AS k")
    sums = df.groupBy("k").count()
    assert {(r.k, r["count"]) for r in attach(df, sums, ["k"], salts=8).collect()} == {(None, 50), ("a", 50)}
    assert attach(df, sums, ["k"], salts=8).count() == 100
