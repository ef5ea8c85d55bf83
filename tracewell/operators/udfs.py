"""User-defined functions and typed operations, all on Arrow batches.

The functions are made inside their operator, so they travel to the tasks by
value.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def net_charge(price: str, discount: str, tax: str) -> Column:
    """price * (1 - discount) * (1 + tax); null when an argument is null."""
    @F.pandas_udf(T.DoubleType())
    def charge(p: pd.Series, d: pd.Series, t: pd.Series) -> pd.Series:
        return p * (1 - d) * (1 + t)

    return charge(price, discount, tax)


def geometric_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """A user aggregate: zero (0, 0), update and partial merge per Arrow batch, final merge in Spark."""
    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.dropna(subset=[value])
            yield rows.assign(log=np.log(rows[value])).groupby(key, as_index=False, dropna=False).agg(n=("log", "size"), log=("log", "sum"))

    kind = df.schema[key].dataType.simpleString()
    parts = df.select(key, value).mapInPandas(update, f"{key} {kind}, n long, log double")
    return parts.groupBy(key).agg(F.exp(F.sum("log") / F.sum("n")).alias("geometric_mean"), F.sum("n").alias("n"))


def register_word_rows(spark) -> str:
    """A table function: (key, text) rows to (key, pos, word, n_chars) rows, by Arrow batches. Returns its SQL name.

    Takes a table argument of two columns; the key is a whole number. Words are parted at
    white space; null and empty texts give no rows.
    """
    class WordRows:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(batch.column(1).cast(pa.string())))
            row = pc.list_parent_indices(words).to_numpy()
            flat = words.flatten()
            first = np.searchsorted(row, row)  # rows are in order, so this is where each one's words begin
            out = pa.table({
                "key": batch.column(0).cast(pa.int64()).take(pa.array(row)), "pos": pa.array(np.arange(len(row)) - first, pa.int32()),
                "word": flat, "n_chars": pc.utf8_length(flat).cast(pa.int32())})
            yield out.filter(pc.not_equal(out["word"], ""))

    spark.udtf.register("word_rows", F.arrow_udtf(WordRows, returnType="key bigint, pos int, word string, n_chars int"))
    return "word_rows"


def flag_counts(df: DataFrame) -> DataFrame:
    """Partition iterator to rows: lines and quantity per return flag and Arrow batch, summed afterwards."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped = pa.Table.from_batches([batch]).group_by("l_returnflag").aggregate([("l_quantity", "count"), ("l_quantity", "sum")])
            out = grouped.select(["l_returnflag", "l_quantity_count", "l_quantity_sum"]).rename_columns(["l_returnflag", "n", "qty"])
            yield from out.combine_chunks().to_batches()

    parts = df.select("l_returnflag", "l_quantity").mapInArrow(count, "l_returnflag string, n long, qty double")
    return parts.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


def map_elements(df: DataFrame) -> DataFrame:
    """A typed row function: one row in, one row out."""
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"p_partkey": rows["p_partkey"], "label": rows["p_brand"].str.upper() + ":" + rows["p_size"].astype(str)})

    return df.select("p_partkey", "p_brand", "p_size").mapInPandas(label, "p_partkey long, label string")


def typed_filter(df: DataFrame, column: str) -> DataFrame:
    """A typed predicate: numbers whose digits add up to an even number, the sign left out. Nulls do not pass."""
    def even_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            left = np.abs(pc.fill_null(values, 0).to_numpy())
            digits = np.zeros(len(left), np.int64)
            while left.any():
                digits += left % 10
                left = left // 10
            yield batch.filter(pa.array((digits % 2 == 0) & pc.is_valid(values).to_numpy(zero_copy_only=False)))

    return df.mapInArrow(even_digits, df.schema)


def daily_trend(daily: DataFrame) -> DataFrame:
    """Per user the least-squares slope of the daily counts; a group has one row per day."""
    def slope(key, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["day_no"].astype(float), rows["n"].astype(float)
        spread = ((x - x.mean()) ** 2).sum()
        value = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread else None
        return pd.DataFrame({"user_id": [key[0]], "n_days": [len(rows)], "slope": [value]})

    return daily.groupBy("user_id").applyInPandas(slope, "user_id long, n_days long, slope double")


def size_band(column: str) -> Column:
    """A key derived by a user function."""
    @F.pandas_udf(T.StringType())
    def band(sizes: pd.Series) -> pd.Series:
        return pd.Series(np.where(sizes <= 10, "small", np.where(sizes <= 30, "medium", "large")))

    return band(column)
