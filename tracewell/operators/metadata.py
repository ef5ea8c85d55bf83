"""Warehouse metadata: lookups, ids, snapshots, and checks of lineage against it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.skew import lookup_join, numbered, sorted_join
from tracewell.storage import cut

NUMBER = r"^[+-]?\d+(\.\d+)?$"


def full_name(*parts: str) -> Column:
    """Lower-case dotted name, the key all lookups share."""
    return F.lower(F.concat_ws(".", *parts))


def table_keys(meta_columns: DataFrame) -> DataFrame:
    """(table_key, table_id) of the tables that have columns."""
    return meta_columns.select(full_name("database_name", "table_name").alias("table_key"), "table_id").distinct()


def column_keys(meta_columns: DataFrame) -> DataFrame:
    """(column_key, column_id, table_id)."""
    return meta_columns.select(full_name("database_name", "table_name", "column_name").alias("column_key"), "column_id", "table_id")


def unknown_ends(ends: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Ends of column edges without metadata; ``problem`` tells a missing table from a missing column."""
    keyed = ends.select("*", F.lower("name").alias("column_key"), F.lower(F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).alias("table_key"))
    unknown = lookup_join(keyed, column_keys(meta_columns).select("column_key"), ["column_key"], "left_anti")
    known = lookup_join(unknown, table_keys(meta_columns), ["table_key"], "left")
    return known.withColumn("problem", F.when(F.col("table_id").isNull(), "table").otherwise("column")).drop("column_key", "table_key", "table_id")


def used_tables(ends: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Table ids with a resolved end: the column id and its table id were both found."""
    names = ends.select(F.lower("name").alias("column_key")).distinct()
    return sorted_join(names, column_keys(meta_columns), ["column_key"]).select("table_id").distinct()


def assign_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Stable ids 1..n in the given order, counted partition by partition."""
    return numbered(df, [], order).withColumnRenamed("rn", name)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns that were added, dropped or retyped between two snapshots.

    Both hold (database_name, table_name, column_name, data_type).
    """
    keys = ["database_name", "table_name", "column_name"]
    both = old.withColumnRenamed("data_type", "old_type").join(new.withColumnRenamed("data_type", "new_type"), keys, "full")
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped")
              .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "retyped"))
    return both.withColumn("change", change).filter("change is not null")


# Checks. Each gives (stmt_id, check, detail).

def _finding(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select("stmt_id", F.lit(check).alias("check"), detail.alias("detail"))


def no_output(refs: DataFrame) -> DataFrame:
    return _finding(refs.filter(F.size("outputs") == 0), "no_output", F.col("stmt_no").cast("string"))


def no_input(refs: DataFrame) -> DataFrame:
    return _finding(refs.filter(F.size("inputs") == 0), "no_input", F.col("stmt_no").cast("string"))


def unknown_tables(refs: DataFrame, meta_tables: DataFrame) -> DataFrame:
    """Tables of statements that metadata does not have, each once per statement and role."""
    roles = F.map_from_arrays(F.array(F.lit("input"), F.lit("output")), F.array("inputs", "outputs"))
    named = (refs.select("stmt_id", F.explode(roles).alias("role", "names"))
             .select("stmt_id", "role", F.explode("names").alias("name")).withColumn("table_key", F.lower("name")).distinct())
    known = meta_tables.select(full_name("database_name", "table_name").alias("table_key"))
    missing = lookup_join(named, known, ["table_key"], "left_anti")
    return _finding(missing, "unknown_table", F.concat_ws(" ", "role", "name"))


def unmatched_output_column(lines: DataFrame) -> DataFrame:
    return _finding(lines.filter(F.coalesce("to_name", F.lit("")) == ""), "unmatched_output_column",
                    F.concat_ws(":", "to_table", F.col("pos").cast("string")))


def target_not_declared(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Column lines whose target no statement of the script declares as output."""
    declared = refs.select("stmt_id", F.explode_outer("outputs").alias("to_table")).filter("to_table is not null").distinct()
    stray = sorted_join(lines, declared, ["stmt_id", "to_table"], "left_anti")
    return _finding(stray, "target_not_declared", F.concat_ws(":", "to_table", "to_name"))


def unknown_source_column(lines: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Source columns their table does not have; numbers are no columns."""
    sources = lines.select("stmt_id", F.explode(F.split("from_names", "&")).alias("source")).distinct()
    named = sources.filter(~F.rlike("source", F.lit(NUMBER)) & (F.col("source") != "")).withColumn("column_key", F.lower("source"))
    missing = lookup_join(named, column_keys(meta_columns).select("column_key"), ["column_key"], "left_anti")
    return _finding(missing, "unknown_source_column", F.col("source"))


def column_count(lines: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Targets whose column number differs from the lines written, or that have none."""
    widths = meta_columns.groupBy(full_name("database_name", "table_name").alias("table_key")).agg(F.count(F.lit(1)).alias("n_columns"))
    written = lines.groupBy("stmt_id", "to_table").agg(F.count_distinct("pos").alias("n_lines")).withColumn("table_key", F.lower("to_table"))
    compared = lookup_join(written, widths, ["table_key"], "left").filter(~F.col("n_lines").eqNullSafe(F.col("n_columns")))
    return _finding(compared, "column_count", F.concat("to_table", F.lit(" "), F.coalesce("n_columns", F.lit(0)), F.lit(" "), "n_lines"))


def report(refs: DataFrame, lines: DataFrame, meta_tables: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """All checks as one table. The statements are read once, their text work is kept."""
    refs = cut(refs.select("stmt_id", "stmt_no", "inputs", "outputs"))
    return reduce(DataFrame.unionByName, [
        no_output(refs), no_input(refs), unknown_tables(refs, meta_tables), unmatched_output_column(lines),
        target_not_declared(lines, refs), unknown_source_column(lines, meta_columns), column_count(lines, meta_columns)])
