"""Column statistics, histograms and calendar expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from tracewell.operators.skew import running
from tracewell.operators.windows import ntile

SKETCH_K, SKETCH_LG_K = 400, 14  # rank error of some 0.7 %, relative error of distinct counts of some 0.8 %
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: values, nulls, distinct, min, max, average and longest text length.

    Each column becomes (column, text, length) rows counted per value before
    anything meets in one place; numbers compare by their numeric value, whole
    numbers exactly (``min_integer``, ``max_integer``), as not all of them are doubles.
    """
    fields = df.schema.fields

    def kind(field: StructField) -> str:
        return field.dataType.simpleString()

    entries = F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.col(f.name).cast("string").alias("text"),
        (F.col(f.name) if kind(f) in (*INTEGERS, "double", "float") else F.lit(None)).cast("double").alias("number"),
        (F.col(f.name) if kind(f) in INTEGERS else F.lit(None)).cast("decimal(20,0)").alias("whole"))
        for f in fields])
    counted = df.select(F.explode(entries).alias("e")).groupBy("e.column_name", "e.text", "e.number", "e.whole").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"),
        F.count("text").alias("n_distinct"), F.min("number").alias("min_number"), F.max("number").alias("max_number"),
        F.min("whole").alias("min_integer"), F.max("whole").alias("max_integer"),
        F.min(F.when(F.col("number").isNull(), F.col("text"))).alias("min_text"), F.max(F.when(F.col("number").isNull(), F.col("text"))).alias("max_text"),
        F.round(F.sum(F.when(F.col("number").isNull(), F.length("text") * F.col("n"))) / F.sum(F.when(F.col("number").isNull() & F.col("text").isNotNull(), F.col("n"))), 6).alias("avg_length"),
        F.max(F.when(F.col("number").isNull(), F.length("text"))).alias("max_length"))


def equi_height_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, ndv, height) with the same number of rows in every bin.

    Equal values are counted first and need no order among them: a value with a
    running count lies in all bins whose places it covers.
    """
    values = df.filter(F.col(column).isNotNull())
    counted = values.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counted, [], [column], {"_upto": F.col("_c")}).crossJoin(values.agg(F.count(F.lit(1)).alias("n")))
    small, rest = F.floor(F.col("n") / bins), F.col("n") % bins

    def end(b: Column) -> Column:
        return b * small + F.least(b, rest)

    from_bin = placed.withColumn("rn", F.col("_upto") - F.col("_c") + 1).withColumn("_first", ntile(bins))
    spread = from_bin.withColumn("rn", F.col("_upto")).withColumn("bin", F.explode(F.sequence("_first", ntile(bins))))
    inside = F.least(F.col("_upto"), end(F.col("bin"))) - F.greatest(F.col("_upto") - F.col("_c"), end(F.col("bin") - 1))
    return spread.groupBy("bin").agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("ndv"), F.sum(inside).cast("bigint").alias("height"))


def summaries(df: DataFrame, keys: Sequence[str], value: str, entity: str) -> DataFrame:
    """One row per ``keys`` with sketches as columns: ``quantiles`` of ``value`` and ``distinct`` values of ``entity``.

    Built by partial aggregation, of a size that does not grow with the rows. Nulls are left out of both.
    """
    return df.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("quantiles"), F.hll_sketch_agg(entity, F.lit(SKETCH_LG_K)).alias("distinct"))


def merged(kept: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Summaries of coarser keys out of kept ones, without the rows they came from."""
    return kept.groupBy(*keys).agg(F.kll_merge_agg_double("quantiles", F.lit(SKETCH_K)).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def calendar(first: Column, last: Column) -> Column:
    """All days between two dates as an array."""
    return F.sequence(first, last, F.expr("interval 1 day"))


def week_start(day: str) -> Column:
    """The Monday of a date's week."""
    return F.to_date(F.date_trunc("week", F.col(day)))
