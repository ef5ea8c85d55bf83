"""Window shapes built on the skew-proof primitives."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.skew import HOT_ROWS, SALTS, attach, ordering, row_frames, split_hot, spread_numbered, spread_ranked


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, tuple], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Values of rows before (negative offset) or after the current one.

    ``columns`` maps a new name to (column, offset) or (column, offset, default).
    """
    offsets = [spec[1] for spec in columns.values()]

    def maker(spec):
        column, offset, *default = spec
        fill = default[0] if default else None
        return (lambda w: F.lead(column, offset, fill).over(w)) if offset >= 0 else (lambda w: F.lag(column, -offset, fill).over(w))

    return row_frames(df, keys, order, max(0, *[-o for o in offsets]), max(0, *offsets), {n: maker(s) for n, s in columns.items()}, hot_rows=hot_rows)


def ntile(n: int) -> Column:
    """The n-tile of a row from its place ``rn`` and the group size ``n``."""
    small = F.floor(F.col("n") / n)
    rest = F.col("n") % n
    wide = rest * (small + 1)
    first = F.floor((F.col("rn") - 1) / (small + 1)) + 1
    later = rest + F.floor((F.col("rn") - 1 - wide) / F.greatest(small, F.lit(1))) + 1
    return F.when(F.col("rn") <= wide, first).otherwise(later).cast("int")


def ranking(df: DataFrame, keys: Sequence[str], order: Sequence[str], ties: Sequence[str], tiles: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``rn``, ``rk``, ``dr``, ``pr`` (percent rank), ``cd`` (cumulative distribution) and ``nt`` (tile).

    ``order`` ranks, ``ties`` tells equal ones apart for ``rn`` and ``nt``. Hot
    keys are looked for once.
    """
    full = [*order, *ties]

    def native(rows: DataFrame) -> DataFrame:
        w, places = Window.partitionBy(*keys).orderBy(*ordering(order)), Window.partitionBy(*keys).orderBy(*ordering(full))
        return rows.select(
            "*", F.row_number().over(places).cast("bigint").alias("rn"), F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"),
            F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"), F.ntile(tiles).over(places).alias("nt"))

    def spread(rows: DataFrame) -> DataFrame:
        placed = spread_ranked(spread_numbered(rows, keys, full), keys, order)
        pr = F.when(F.col("n") == 1, 0.0).otherwise((F.col("rk") - 1) / (F.col("n") - 1))
        return placed.select(*rows.columns, "rn", "rk", "dr", pr.alias("pr"), (F.col("upto") / F.col("n")).alias("cd"), ntile(tiles).alias("nt"))

    return split_hot(df, keys, native, spread, hot_rows)


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """A value as a share of its group's total: totals are aggregated, then joined back."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return attach(df, totals, keys, salts=SALTS).withColumn(name, F.col(value) / F.col("_total")).drop("_total")


def range_frame(df: DataFrame, keys: Sequence[str], on: str, back: int, width: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over rows whose whole-number ``on`` lies in [current - back, current].

    Equal values are added up first, so a window row stands for one value of a
    key. Values are cut into steps of ``width`` (at least ``back``); those a
    later step still sees are copied into it as context. A window therefore
    holds at most ``back + width`` rows.
    """
    if width < back:
        raise ValueError("steps must be at least as wide as the frame")
    values = df.groupBy(*keys, on).agg(*[F.sum(v).alias(f"_v_{n}") for n, v in sums.items()])
    step = F.floor(F.col(on) / width)
    seen_by = F.array_distinct(F.array(step, F.floor((F.col(on) + back) / width)))
    spread = values.withColumn("_home", step).withColumn("_step", F.explode(seen_by))
    w = Window.partitionBy(*keys, "_step").orderBy(on).rangeBetween(-back, 0)
    framed = spread.select(*keys, on, "_home", "_step", *[F.sum(f"_v_{n}").over(w).alias(n) for n in sums])
    return attach(df, framed.filter("_step = _home").drop("_home", "_step"), [*keys, on])


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int, measures: dict[str, Column]) -> DataFrame:
    """Gap sessions per key, built per day and then joined over the day borders.

    Events of one minute are added up before the first shuffle, so a key has at
    most 1440 rows per day. Sessions inside a day are final; only a day's first
    and last one can go on into its neighbour, so two rows per key and day at
    most are ordered again. ``measures`` are sums. Result: (key, session_start,
    session_end, n, ..), the end being the last event.
    """
    if gap_minutes < 2:
        raise ValueError("the gap must be longer than a minute")
    columns = [key, "session_start", "session_end", "n", *measures]
    minutes = df.groupBy(key, F.date_trunc("minute", F.col(ts)).alias("_minute")).agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(m) for m, v in measures.items()])
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    span = F.unix_micros(F.col("session_end").cast("timestamp")) - F.unix_micros(F.col("session_start").cast("timestamp"))
    reach = F.make_interval(mins=F.lit(gap_minutes), secs=(span / 1e6).cast("decimal(18,6)"))
    daily = minutes.groupBy(key, F.to_date("_minute").alias("_day"), F.session_window("session_start", reach)).agg(
        F.min("session_start").alias("_s"), F.max("session_end").alias("session_end"), F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures])
    daily = daily.select(key, "_day", F.col("_s").alias("session_start"), "session_end", "n", *measures)
    edge = daily.groupBy(key, "_day").agg(F.min("session_start").alias("_first"), F.max("session_start").alias("_last"))
    marked = attach(daily, edge, [key, "_day"]).withColumn(
        "_border", (F.col("session_start") == F.col("_first")) | (F.col("session_start") == F.col("_last")))
    w = Window.partitionBy(key).orderBy("session_start")
    far = F.coalesce(F.col("session_start") > F.lag("session_end").over(w) + gap, F.lit(True))
    same_day = F.coalesce(F.lag("_day").over(w) == F.col("_day"), F.lit(False))  # the day's first and last session
    marked_border = marked.filter("_border").withColumn("_new", (far | same_day).cast("int"))
    joined = marked_border.withColumn("_no", F.sum("_new").over(w)).groupBy(key, "_no").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures])
    return marked.filter("not _border").select(*columns).unionByName(joined.select(*columns))
