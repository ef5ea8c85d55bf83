"""Queries over warehouse metadata and checks of lineage against it."""
from pyspark.sql import functions as F

from tracewell.operators import metadata as M
from tracewell.operators import scripts as S
from tracewell.operators import statements as T
from tracewell.operators.skew import lookup_join
from tracewell.registry import query
from tracewell.sources import columns_of, fixture, table
from tracewell.sources.tables import TABLES

from .table_lineage import STMTS, due_refs

COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES) + ")"
NAMES = ", ".join(f"'{t}'" for t in TABLES)


def catalog_rows(spark, d):
    """(table_name, ordinal, column_name, n_rows) of every table of the folder."""
    rows = spark.createDataFrame([(t, o, c) for t, o, c, _ in columns_of(spark, d)], "table_name string, ordinal int, column_name string")
    counts = None
    for name in TABLES:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return rows.join(counts, "table_name")


@query("src_catalog_introspect", f"""
WITH {COUNTS} SELECT c.table_name, CAST(c.ordinal_position AS INT) AS ordinal, c.column_name, n.n_rows
FROM information_schema.columns c JOIN counts n ON n.table_name = c.table_name WHERE c.table_name IN ({NAMES})
""")
def src_catalog_introspect(spark, d):
    return catalog_rows(spark, d)


@query("src_table_columns", f"""
WITH {COUNTS} SELECT c.table_name, string_agg(c.column_name, ',' ORDER BY c.ordinal_position) AS columns, max(n.n_rows) AS n_rows
FROM information_schema.columns c JOIN counts n ON n.table_name = c.table_name WHERE c.table_name IN ({NAMES}) GROUP BY 1
""")
def src_table_columns(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    return catalog_rows(spark, d).groupBy("table_name").agg(
        F.array_join(F.transform(ordered, lambda c: c["column_name"]), ",").alias("columns"), F.max("n_rows").alias("n_rows"))


@query("src_jdbc_scan", """
SELECT database_name, count(DISTINCT table_name) AS n_tables, count(*) AS n_columns FROM f_wide_columns GROUP BY 1
""", ("f_wide_columns",))
def src_jdbc_scan(spark, d):
    """The metadata query of the relational store over the same tables in Parquet form."""
    per_table = fixture(spark, d, "f_wide_columns").groupBy("database_name", "table_name").agg(F.count(F.lit(1)).alias("n"))
    return per_table.groupBy("database_name").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n").alias("n_columns"))


@query("src_tasks_scan", """
SELECT t.id, t.name, split_part(concat(t.app_path, '/', t.main_class), ' ', 1) AS path, c.c_name AS user_name, concat(lower(c.c_mktsegment), '@example.com') AS mail
FROM f_tasks t JOIN customer c ON c.c_custkey = t.user_id
WHERE t.state = 1 AND t.type IN ('SHELL', 'HIVE') AND t.id >= 10 AND t.update_date >= TIMESTAMP '1996-01-01 00:00:00'
""", ("f_tasks",))
def src_tasks_scan(spark, d):
    users = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("mail"))
    due = fixture(spark, d, "f_tasks").filter(
        (F.col("state") == 1) & F.col("type").isin("SHELL", "HIVE") & (F.col("id") >= 10)
        & (F.col("update_date") >= F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")))
    path = F.substring_index(F.concat_ws("/", "app_path", "main_class"), " ", 1)
    return due.select("id", "name", path.alias("path"), "user_id").join(users, "user_id").drop("user_id").orderBy("id")


@query("meta_table_lookup", """
SELECT l.stmt_id, l.pos, l.to_table, t.table_id FROM f_col_lines l JOIN f_meta_table t ON concat(t.database_name, '.', t.table_name) = l.to_table
""", ("f_col_lines", "f_meta_table"))
def meta_table_lookup(spark, d):
    tables = fixture(spark, d, "f_meta_table").select(F.struct("database_name", "table_name").alias("key"), "table_id")
    lines = fixture(spark, d, "f_col_lines").select("stmt_id", "pos", "to_table", F.struct(
        F.substring_index("to_table", ".", 1).alias("database_name"), F.substring_index("to_table", ".", -1).alias("table_name")).alias("key"))
    return lookup_join(lines, tables, ["key"]).drop("key")


@query("meta_column_lookup", """
SELECT l.stmt_id, l.pos, upper(l.from_names) AS source, c.column_id FROM f_col_lines l
LEFT JOIN f_meta_column c ON lower(concat(c.database_name, '.', c.table_name, '.', c.column_name)) = lower(upper(l.from_names))
""", ("f_col_lines", "f_meta_column"))
def meta_column_lookup(spark, d):
    keys = M.column_keys(fixture(spark, d, "f_meta_column")).select("column_key", "column_id")
    lines = fixture(spark, d, "f_col_lines").select("stmt_id", "pos", F.upper("from_names").alias("source"))
    return lookup_join(lines.withColumn("column_key", F.lower("source")), keys, ["column_key"], "left").drop("column_key")


@query("meta_columns_of_table", """
SELECT t.stmt_id, t.to_table, string_agg(c.column_name, ',' ORDER BY c.ordinal) AS columns
FROM (SELECT DISTINCT stmt_id, to_table FROM f_col_lines) t JOIN f_meta_column c ON concat(c.database_name, '.', c.table_name) = t.to_table GROUP BY 1, 2
""", ("f_col_lines", "f_meta_column"))
def meta_columns_of_table(spark, d):
    lists = fixture(spark, d, "f_meta_column").groupBy(M.full_name("database_name", "table_name").alias("table_key")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]), ",").alias("columns"))
    targets = fixture(spark, d, "f_col_lines").select("stmt_id", "to_table").distinct().withColumn("table_key", F.lower("to_table"))
    return lookup_join(targets, lists, ["table_key"]).drop("table_key")


@query("meta_assign_ids", """
SELECT CAST(row_number() OVER (ORDER BY stmt_id, branch, pos) AS BIGINT) AS relation_id, stmt_id, branch, pos FROM f_col_lines
""", ("f_col_lines",))
def meta_assign_ids(spark, d):
    return M.assign_ids(fixture(spark, d, "f_col_lines").select("stmt_id", "branch", "pos"), "relation_id", "stmt_id", "branch", "pos")


@query("meta_snapshot_diff", """
SELECT coalesce(o.database_name, n.database_name) AS database_name, coalesce(o.table_name, n.table_name) AS table_name,
       coalesce(o.column_name, n.column_name) AS column_name, o.data_type AS old_type, n.data_type AS new_type,
       CASE WHEN o.data_type IS NULL THEN 'added' WHEN n.data_type IS NULL THEN 'dropped' ELSE 'retyped' END AS change
FROM f_wide_columns_old o FULL JOIN f_wide_columns n ON o.database_name = n.database_name AND o.table_name = n.table_name AND o.column_name = n.column_name
WHERE o.data_type IS DISTINCT FROM n.data_type
""", ("f_wide_columns", "f_wide_columns_old"))
def meta_snapshot_diff(spark, d):
    return M.snapshot_diff(fixture(spark, d, "f_wide_columns_old"), fixture(spark, d, "f_wide_columns"))


def stmt_refs(spark, d):
    return due_refs(spark, d).withColumnRenamed("job_id", "stmt_id")


def col_lines(spark, d):
    return fixture(spark, d, "f_col_lines")


CHECKS = STMTS.rstrip() + """,
known AS (SELECT DISTINCT concat(database_name, '.', table_name) AS name FROM f_meta_table),
old_columns AS (SELECT concat(database_name, '.', table_name, '.', column_name) AS name FROM f_meta_column_old),
no_output AS (SELECT job_id AS stmt_id, 'no_output' AS "check", CAST(stmt_no AS VARCHAR) AS detail FROM due WHERE len(outputs) = 0),
no_input AS (SELECT job_id AS stmt_id, 'no_input' AS "check", CAST(stmt_no AS VARCHAR) AS detail FROM due WHERE len(inputs) = 0),
unknown_table AS (
  SELECT DISTINCT stmt_id, 'unknown_table' AS "check", concat(role, ' ', name) AS detail FROM (
    SELECT job_id AS stmt_id, 'input' AS role, unnest(inputs) AS name FROM due UNION ALL SELECT job_id, 'output', unnest(outputs) FROM due)
  WHERE lower(name) NOT IN (SELECT name FROM known)),
unmatched AS (SELECT stmt_id, 'unmatched_output_column' AS "check", concat(to_table, ':', pos) AS detail FROM f_col_lines WHERE to_name = ''),
stray AS (
  SELECT l.stmt_id, 'target_not_declared' AS "check", concat(l.to_table, ':', l.to_name) AS detail FROM f_col_lines l
  WHERE NOT EXISTS (SELECT 1 FROM due d WHERE d.job_id = l.stmt_id AND list_contains(d.outputs, l.to_table))),
missing_source AS (
  SELECT DISTINCT stmt_id, 'unknown_source_column' AS "check", from_names AS detail FROM f_col_lines
  WHERE NOT regexp_matches(from_names, '^[+-]?\\d+(\\.\\d+)?$') AND lower(from_names) NOT IN (SELECT name FROM old_columns)),
widths AS (SELECT concat(database_name, '.', table_name) AS name, count(*) AS n FROM f_meta_column_old GROUP BY 1),
counts AS (
  SELECT l.stmt_id, 'column_count' AS "check", concat(l.to_table, ' ', coalesce(w.n, 0), ' ', l.n) AS detail
  FROM (SELECT stmt_id, to_table, count(DISTINCT pos) AS n FROM f_col_lines GROUP BY ALL) l LEFT JOIN widths w ON w.name = l.to_table WHERE l.n IS DISTINCT FROM w.n)
"""
CHECKED = ("f_jobs", "f_col_lines", "f_meta_table", "f_meta_column_old")


@query("val_no_output", CHECKS + "SELECT * FROM no_output", CHECKED)
def val_no_output(spark, d):
    return M.no_output(stmt_refs(spark, d))


@query("val_no_input", CHECKS + "SELECT * FROM no_input", CHECKED)
def val_no_input(spark, d):
    return M.no_input(stmt_refs(spark, d))


@query("val_unknown_tables", CHECKS + "SELECT * FROM unknown_table", CHECKED)
def val_unknown_tables(spark, d):
    return M.unknown_tables(stmt_refs(spark, d), fixture(spark, d, "f_meta_table"))


@query("val_unmatched_output_column", CHECKS + "SELECT * FROM unmatched", CHECKED)
def val_unmatched_output_column(spark, d):
    return M.unmatched_output_column(col_lines(spark, d))


@query("val_target_not_declared", CHECKS + "SELECT * FROM stray", CHECKED)
def val_target_not_declared(spark, d):
    return M.target_not_declared(col_lines(spark, d), stmt_refs(spark, d))


@query("val_unknown_source_column", CHECKS + "SELECT * FROM missing_source", CHECKED)
def val_unknown_source_column(spark, d):
    return M.unknown_source_column(col_lines(spark, d), fixture(spark, d, "f_meta_column_old"))


@query("val_column_count", CHECKS + "SELECT * FROM counts", CHECKED)
def val_column_count(spark, d):
    return M.column_count(col_lines(spark, d), fixture(spark, d, "f_meta_column_old"))


@query("val_report", CHECKS + " UNION ALL ".join(f"SELECT * FROM {v}" for v in ("no_output", "no_input", "unknown_table", "unmatched", "stray", "missing_source", "counts")), CHECKED)
def val_report(spark, d):
    return M.report(stmt_refs(spark, d), col_lines(spark, d), fixture(spark, d, "f_meta_table"), fixture(spark, d, "f_meta_column_old"))


@query("dq_assert", "SELECT l_returnflag, count(*) AS n_checked FROM lineitem GROUP BY 1")
def dq_assert(spark, d):
    """Fails the job when a discount leaves its range or a price is negative."""
    passed = F.assert_true((F.col("l_discount") >= 0) & (F.col("l_discount") <= 1) & (F.col("l_extendedprice") >= 0), "price or discount out of range")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(passed.isNull()).alias("n_checked"))
