"""Joins and prefix sums that hold when one key owns a large share of the rows.

Windows run natively for all ordinary keys. Keys with very many rows are found
by a count first (``split_hot``); their rows are dealt over range partitions of
(key, ordering), numbered inside each, and shifted by what the partitions before
them hold. That needs one small row per key and partition.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType, StringType

from tracewell.storage import keep

SALTS = 8
HOT_ROWS = 500_000
CHUNK = 65_536


def _salt_of(rows: DataFrame, salts: int) -> Column:
    """A number below ``salts`` from the numbers and dates of a row, from its texts where it has nothing else."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    short = [n for n, t in kinds.items() if isinstance(t, (NumericType, DatetimeType, BooleanType))]
    return F.pmod(F.xxhash64(*(short or [n for n, t in kinds.items() if isinstance(t, StringType)] or [F.lit(0)])), F.lit(salts)).cast("int")


def sorted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the input.

    Spark sizes a side by the compressed files it comes from, also behind cut
    lineage, and would broadcast one that is a hundred times as large in memory.
    """
    return left.join(right.hint("merge"), [*keys], how)


def lookup_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS, small: bool = False) -> DataFrame:
    """Join rows with a lookup much smaller than they are (metadata, settings, graph frontiers).

    Rows of one key are dealt over ``salts`` tasks by a hash of their numbers and
    dates (of their texts, where they have nothing else), the lookup is copied once
    per salt. It may grow with the input and is never broadcast, except a ``small``
    one, which does not grow: there the kind of join is left to Spark.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the rows must be the preserved side, not {how}")
    salt = _salt_of(big, salts)
    copies = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    dealt = big.withColumn("_salt", salt)
    return (dealt.join(copies, [*keys, "_salt"], how) if small else sorted_join(dealt, copies, [*keys, "_salt"], how)).drop("_salt")


def ordering(order: Sequence[str]) -> list[Column]:
    """Sort columns from names; a leading ``-`` means descending."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def plain(order: Sequence[str]) -> list[str]:
    return [c.lstrip("-") for c in order]


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], small: bool = False, salts: int = 1) -> DataFrame:
    """Join numbers per key back on, nulls in keys included.

    With ``salts`` the rows of a key are dealt over as many tasks and the numbers
    copied once per salt, for few keys with many rows.
    """
    if salts > 1:
        dealt = df.withColumn("_salt", _salt_of(df, salts))
        copies = stats.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        return attach(dealt, copies, [*keys, "_salt"], small).drop("_salt")
    renamed = stats.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return df.join(F.broadcast(renamed) if small else renamed, on).drop(*[f"_r_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """All keys with more than ``hot_rows`` rows, as a kept table; None when there are none."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
    found = keep(counted)
    return None if found.isEmpty() else found


def split_hot(df: DataFrame, keys: Sequence[str], native: Callable[[DataFrame], DataFrame],
              spread: Callable[[DataFrame], DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``native`` for ordinary keys, ``spread`` for hot ones; without keys everything is spread."""
    if not keys:
        return spread(df)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return native(df)
    named = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    cold = native(df.join(named, on, "left_anti"))
    return cold.unionByName(spread(df.join(named, on, "left_semi")))


def _range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in range partitions of (keys, order), each row with the number of its partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *ordering(order))
    return keep(ranged.withColumn("_part", F.spark_partition_id()))


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
            peers: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running totals per key up to the current row, or with ``peers`` up to its last equal one."""
    if peers:
        return _running_peers(df, keys, order, sums, hot_rows)

    def native(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*ordering(order)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(v).over(w).alias(n) for n, v in sums.items()])

    return split_hot(df, keys, native, lambda rows: _spread_running(rows, keys, order, sums), hot_rows)


def _spread_running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Running totals inside range partitions, shifted by the totals of the partitions before."""
    placed = _range_parts(rows.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()]), keys, order)
    stats = placed.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    stats = stats.select(*keys, "_part", *[F.sum(f"_s_{n}").over(_before(keys)).alias(f"_b_{n}") for n in sums])
    joined = attach(placed, stats, [*keys, "_part"], small=True)  # a row per hot key and partition
    w = Window.partitionBy(*keys, "_part").orderBy(*ordering(order)).rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        here = F.sum(f"_v_{name}").over(w)
        joined = joined.withColumn(name, F.when(here.isNull(), F.col(f"_b_{name}")).otherwise(here + F.coalesce(f"_b_{name}", F.lit(0))))
    return joined.drop("_part", *[f"_{p}_{n}" for n in sums for p in ("v", "b")])


def _running_peers(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], hot_rows: int) -> DataFrame:
    def native(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*ordering(order)).rangeBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(v).over(w).alias(n) for n, v in sums.items()])

    def spread(rows: DataFrame) -> DataFrame:
        values = rows.groupBy(*keys, *plain(order)).agg(*[F.sum(v).alias(f"_p_{n}") for n, v in sums.items()])
        totals = _spread_running(values, keys, order, {n: F.col(f"_p_{n}") for n in sums}).drop(*[f"_p_{n}" for n in sums])
        return attach(rows, totals, [*keys, *plain(order)])

    return split_hot(df, keys, native, spread, hot_rows)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``rn``, the place of a row in its key. ``order`` should tell all rows apart."""
    return running(df, keys, order, {"rn": F.lit(1).cast("bigint")}, hot_rows=hot_rows)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``rk`` (rank), ``dr`` (dense rank), ``upto`` (rows up to the last equal one) and ``n`` (rows of the key)."""
    def native(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*ordering(order))
        return rows.select(
            "*", F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"),
            F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("upto"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))

    return split_hot(df, keys, native, lambda rows: spread_ranked(rows, keys, order), hot_rows)


def spread_ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``ranked`` for hot keys: counts per distinct value, ranked over range partitions and joined back."""
    values = rows.groupBy(*keys, *plain(order)).agg(F.count(F.lit(1)).alias("_c"))
    placed = _spread_running(values, keys, order, {"upto": F.col("_c"), "dr": F.lit(1).cast("bigint")})
    placed = placed.withColumn("rk", F.col("upto") - F.col("_c") + 1).drop("_c")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    full = attach(placed, sizes, keys) if keys else placed.crossJoin(sizes)
    return attach(rows, full, [*keys, *plain(order)]).select(*rows.columns, "rk", "dr", "upto", "n")


def spread_numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``numbered`` for hot keys."""
    return _spread_running(rows, keys, order, {"rn": F.lit(1).cast("bigint")})


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The last non-null value up to and including the current row, in ascending order."""
    def native(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))

    def spread(rows: DataFrame) -> DataFrame:
        placed = _range_parts(rows, keys, order)
        known = F.when(F.col(value).isNotNull(), F.struct(*order))
        stats = placed.groupBy(*keys, "_part").agg(F.max_by(value, known).alias("_l"))
        stats = stats.select(*keys, "_part", F.last("_l", ignorenulls=True).over(_before(keys)).alias("_carry"))
        joined = attach(placed, stats, [*keys, "_part"], small=True)
        w = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("_carry"))).drop("_part", "_carry")

    return split_hot(df, keys, native, spread, hot_rows)


def row_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int,
               columns: dict[str, Callable], chunk: int = CHUNK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Windows that look ``before`` rows back and ``after`` rows ahead.

    ``columns`` maps a name to a function of the ordered window. Rows of a hot
    key are cut into chunks of fixed length; rows near a border are copied into
    the neighbouring chunk, used there as context and dropped again.
    """
    if max(before, after) >= chunk:
        raise ValueError("a frame must be shorter than a chunk")

    def native(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*ordering(order))
        return rows.select("*", *[make(w).alias(n) for n, make in columns.items()])

    def spread(rows: DataFrame) -> DataFrame:
        placed = spread_numbered(rows, keys, order)
        place = (F.col("rn") - 1) % chunk
        targets = F.filter(F.array(F.lit(0), F.when(place >= chunk - before, F.lit(1)), F.when(place < after, F.lit(-1))), lambda x: x.isNotNull())
        copied = (placed.withColumn("_shift", F.explode(targets))
                  .withColumn("_chunk", F.floor((F.col("rn") - 1) / chunk) + F.col("_shift")))
        w = Window.partitionBy(*keys, "_chunk").orderBy("rn")
        framed = copied.select("*", *[make(w).alias(n) for n, make in columns.items()])
        return framed.filter("_shift = 0").drop("_shift", "_chunk", "rn")

    return split_hot(df, keys, native, spread, hot_rows)
