"""Joins on ranges and intervals, and guarded broadcasts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count has shown at most ``max_rows`` rows; else leave the choice to Spark."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= value < high``, joined on steps of ``width``.

    A range is written to each step it touches, a point lies in exactly one,
    so no pair is found twice.
    """
    steps = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = ranges.filter(F.col(low) < F.col(high)).withColumn("_step", F.explode(steps))
    placed = points.withColumn("_step", F.floor(F.col(value) / width))
    return placed.join(spread, "_step").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_step")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, minutes: int) -> DataFrame:
    """Pairs of one key with ``left_ts < right_ts <= left_ts + minutes``.

    Time steps of the interval's length join the key, which also spreads a key
    with very many events.
    """
    seconds = minutes * 60

    def step(ts: str):
        return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)

    spread = left.withColumn("_step", F.explode(F.array(step(left_ts), step(left_ts) + 1)))
    placed = right.withColumn("_step", step(right_ts))
    end = F.col(left_ts) + F.make_dt_interval(mins=F.lit(minutes))
    return placed.join(spread, [*keys, "_step"]).filter((F.col(right_ts) > F.col(left_ts)) & (F.col(right_ts) <= end)).drop("_step")


def not_in(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows whose key is NOT IN a one-column frame, with the rules for nulls.

    A null among the values, or a null key against any value, makes the answer
    unknown. Both are decided by one counted row, so the rest is a plain anti
    join that never has to copy the values to every task.
    """
    name = values.columns[0]
    facts = values.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(name).isNull()).alias("_nulls"))
    wanted = values.filter(F.col(name).isNotNull()).select(F.col(name).alias(key)).distinct()
    known = df.crossJoin(F.broadcast(facts)).filter("_nulls = 0").filter(F.col(key).isNotNull() | (F.col("_n") == 0))
    return known.join(wanted, key, "left_anti").drop("_n", "_nulls")
