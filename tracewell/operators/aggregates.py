"""Aggregates that need more than one built-in call."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.skew import SALTS, attach, running


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per key.

    Equal values are counted first; running counts over the distinct values
    then tell which of them hold the two rows around each wanted place. No key
    is gathered in one buffer.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_freq"))
    placed = running(counted, keys, [value], {"_upto": F.col("_freq")})
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    sized = attach(placed, sizes, keys, salts=SALTS)
    first = F.col("_upto") - F.col("_freq")

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < F.col("_upto")), F.col(value)))

    def point(p: float) -> list[Column]:
        place = F.lit(p) * (F.col("_n") - 1)
        return [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]

    picked = sized.groupBy(*keys).agg(*[c.alias(f"_{part}_{n}") for n, p in points.items() for part, c in zip(("lo", "hi", "w"), point(p))])
    return picked.select(*keys, *[(F.col(f"_lo_{n}") * (1 - F.col(f"_w_{n}")) + F.col(f"_hi_{n}") * F.col(f"_w_{n}")).alias(n) for n in points])


def frequency_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles of a value with few distinct ones, by Spark's percentile with frequencies."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_freq"))
    return counted.groupBy(*keys).agg(*[F.percentile(value, p, F.col("_freq")).alias(n) for n, p in points.items()])


def interval_of(column: str, borders: Sequence[float]) -> Column:
    """Number of the interval a value lies in, 1-based; closed on the right, the first on both sides."""
    inside = F.when(F.col(column) == borders[0], 1)
    for number, (low, high) in enumerate(zip(borders, borders[1:]), start=1):
        inside = inside.when((F.col(column) > low) & (F.col(column) <= high), number)
    return inside


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in ``order``, found by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def count_min_size(sketch: Column, part: str) -> Column:
    """``total``, ``depth`` or ``width`` out of the head of a count-min sketch given in hexadecimal."""
    first, digits = {"total": (9, 16), "depth": (25, 8), "width": (33, 8)}[part]
    return F.conv(F.substring(sketch, first, digits), 16, 10).cast("bigint")


def count_min_estimate(sketch: Column, item: Column) -> Column:
    """How often a whole number was counted, read from a count-min sketch given in hexadecimal.

    The least of its cells, one per row of the table; never below the true count.
    Takes numbers of at most 32 bits, whose products with the multipliers fit into 64;
    a null item or sketch gives null.
    """
    depth, width = count_min_size(sketch, "depth"), count_min_size(sketch, "width")

    def long_at(place: Column) -> Column:  # the places behind the head: the multipliers, then the table
        return F.conv(F.substr(sketch, (place * 16 + 41).cast("int"), F.lit(16)), 16, 10).cast("bigint")

    def cell(row: Column) -> Column:
        product = long_at(row) * item.cast("bigint")
        folded = (product + F.shiftright(product, 32)).bitwiseAND(F.lit((1 << 31) - 1))
        return long_at(depth + row * width + folded % width)

    return F.array_min(F.transform(F.sequence(F.lit(0).cast("bigint"), depth - 1), cell))
