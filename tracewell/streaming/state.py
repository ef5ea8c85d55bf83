"""Grouped state over streams, on per-task partial counts.

A map step adds up each Arrow batch before the shuffle, so a group with very
many rows arrives as few partial rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PARTIAL = "user_id long, ts timestamp, n long, total double"


def partial_counts(events: DataFrame) -> DataFrame:
    """(user_id, ts, n, total) per user and Arrow batch, ``ts`` being the last; events without a user are a group."""
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.groupby("user_id", as_index=False, dropna=False).agg(
                ts=("ts", "max"), n=("value", "size"), total=("value", lambda v: v.sum(min_count=1)))

    return events.select("user_id", "ts", "value").mapInPandas(add_up, PARTIAL)


def running_totals(events: DataFrame) -> DataFrame:
    """One row per user and update: all events so far and their value."""
    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, None)
        for part in parts:
            n, known = n + int(part["n"].sum()), part["total"].dropna()
            total = (total or 0.0) + float(known.sum()) if len(known) else total
        state.update((n, total))
        yield pd.DataFrame({"user_id": pd.Series([key[0]], dtype="Int64"), "n": [n], "total": pd.Series([total], dtype="float64")})

    return partial_counts(events).groupBy("user_id").applyInPandasWithState(
        update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def milestones(events: DataFrame, every: int) -> DataFrame:
    """One row for each multiple of ``every`` events a user reaches; none or many per batch."""
    def reached(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(int(part["n"].sum()) for part in parts)
        state.update((now,))
        marks = [m * every for m in range(before // every + 1, now // every + 1)]
        yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(marks), dtype="Int64"), "milestone": pd.Series(marks, dtype="int64")})

    return partial_counts(events).groupBy("user_id").applyInPandasWithState(
        reached, "user_id long, milestone long", "n long", "append", GroupStateTimeout.NoTimeout)


def silent_users(events: DataFrame, gap_ms: int) -> DataFrame:
    """Users without an event for ``gap_ms``, told when the watermark passes that moment.

    ``events`` carries a watermark on ``ts``.
    """
    def watch(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"user_id": pd.Series([key[0]], dtype="Int64"), "n": [n], "last_ms": [last]})
            return
        n, last = state.get if state.exists else (0, 0)
        for part in parts:
            n += int(part["n"].sum())
            last = max(last, int(part["ts"].max().value // 1_000_000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))

    return partial_with_watermark(events).groupBy("user_id").applyInPandasWithState(
        watch, "user_id long, n long, last_ms long", "n long, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def partial_with_watermark(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Partial counts with the watermark set on their last event time."""
    return partial_counts(events).withWatermark("ts", delay)
