"""Queries from scripts to statements, tables and table edges."""
from pyspark.sql import functions as F

from tracewell.operators import scripts as S
from tracewell.operators import statements as T
from tracewell.registry import query
from tracewell.sources import fixture, use_all_cores

STMTS = """
WITH clean AS (
  SELECT id AS job_id, run_type, auto, array_to_string(list_filter(string_split(script, chr(10)), lambda l: NOT starts_with(trim(l), '--')), chr(10)) AS script FROM f_jobs),
parts AS (
  SELECT job_id, run_type, auto, CAST(unnest(range(len(string_split(script, ';')))) AS INT) AS stmt_no, unnest(string_split(script, ';')) AS raw FROM clean),
trimmed AS (SELECT job_id, run_type, auto, stmt_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS stmt FROM parts),
scoped AS (
  SELECT *, coalesce(last_value(nullif(regexp_extract(stmt, '(?i)^use\\s+(\\w+)', 1), '') IGNORE NULLS)
            OVER (PARTITION BY job_id ORDER BY stmt_no ROWS UNBOUNDED PRECEDING), 'default') AS database_name FROM trimmed),
stmts AS (SELECT * FROM scoped WHERE stmt <> '' AND NOT regexp_matches(stmt, '(?i)^(set|add)\\b')),
raws AS (
  SELECT *, list_distinct(regexp_extract_all(stmt, '(?i)\\b(?:from|join)\\s+([A-Za-z_][\\w.]*)', 1)) AS ins,
         list_distinct(regexp_extract_all(stmt, '(?i)\\b(?:insert\\s+(?:into|overwrite)\\s+table|create\\s+table(?:\\s+if\\s+not\\s+exists)?)\\s+([A-Za-z_][\\w.]*)', 1)) AS outs,
         list_distinct(regexp_extract_all(stmt, '(?i)(?:\\bwith|,)\\s+(\\w+)\\s+as\\s*\\(', 1)) AS ctes FROM stmts),
refs AS (
  SELECT job_id, run_type, auto, stmt_no, stmt, database_name,
         list_transform(list_filter(ins, lambda n: NOT list_contains(ctes, n)), lambda n: CASE WHEN contains(n, '.') THEN n ELSE concat(database_name, '.', n) END) AS inputs,
         list_transform(outs, lambda n: CASE WHEN contains(n, '.') THEN n ELSE concat(database_name, '.', n) END) AS outputs FROM raws),
due AS (SELECT * FROM refs WHERE run_type IN ('hive', 'spark') AND auto = 1),
edges AS (
  SELECT DISTINCT split_part(src, '.', 1) AS src_db, split_part(src, '.', 2) AS src_table, split_part(dst, '.', 1) AS dst_db, split_part(dst, '.', 2) AS dst_table
  FROM (SELECT unnest(inputs) AS src, outputs FROM due) i, unnest(outputs) AS o(dst))
"""


def jobs_of(spark, d):
    return use_all_cores(fixture(spark, d, "f_jobs"))


def stmts_of(spark, d):
    return use_all_cores(fixture(spark, d, "f_stmts"))


def due_refs(spark, d):
    """Qualified tables of the statements of scheduled jobs."""
    return T.table_refs(S.scheduled_jobs(jobs_of(spark, d)))


@query("lin_strip_comments", STMTS + "SELECT job_id, script FROM clean", ("f_jobs",))
def lin_strip_comments(spark, d):
    return jobs_of(spark, d).select(F.col("id").alias("job_id"), T.strip_comments().alias("script"))


@query("lin_split_statements", STMTS + "SELECT job_id, stmt_no, stmt FROM stmts", ("f_jobs",))
def lin_split_statements(spark, d):
    return T.statements(jobs_of(spark, d))


@query("lin_use_db_scope", STMTS + "SELECT job_id, stmt_no, database_name FROM stmts", ("f_jobs",))
def lin_use_db_scope(spark, d):
    return T.scoped_statements(jobs_of(spark, d)).select("job_id", "stmt_no", "database_name")


@query("lin_qualify_names", STMTS + """
SELECT job_id, stmt_no, array_to_string(list_sort(ins), '&') AS written,
       array_to_string(list_transform(list_sort(ins), lambda n: CASE WHEN contains(n, '.') THEN n ELSE concat(database_name, '.', n) END), '&') AS qualified
FROM raws WHERE len(ins) > 0
""", ("f_jobs",))
def lin_qualify_names(spark, d):
    rows = T.scoped_statements(jobs_of(spark, d)).withColumn("written", F.array_join(F.array_sort(T.input_names()), "&"))
    return rows.filter("written <> ''").select("job_id", "stmt_no", "written", T.qualify(F.col("written"), F.col("database_name")).alias("qualified"))


@query("lin_input_tables", STMTS + "SELECT job_id, stmt_no, unnest(ins) AS input_table FROM raws", ("f_jobs",))
def lin_input_tables(spark, d):
    return T.statements(jobs_of(spark, d)).select("job_id", "stmt_no", F.explode(T.input_names()).alias("input_table"))


@query("lin_output_tables", STMTS + "SELECT job_id, stmt_no, unnest(outs) AS output_table FROM raws", ("f_jobs",))
def lin_output_tables(spark, d):
    return T.statements(jobs_of(spark, d)).select("job_id", "stmt_no", F.explode(T.output_names()).alias("output_table"))


@query("lin_cte_tables", STMTS + "SELECT job_id, stmt_no, unnest(ctes) AS cte_name FROM raws", ("f_jobs",))
def lin_cte_tables(spark, d):
    return T.statements(jobs_of(spark, d)).select("job_id", "stmt_no", F.explode(T.cte_names()).alias("cte_name"))


@query("lin_real_inputs", STMTS + "SELECT job_id, stmt_no, unnest(inputs) AS input_table FROM refs", ("f_jobs",))
def lin_real_inputs(spark, d):
    return T.table_refs(jobs_of(spark, d)).select("job_id", "stmt_no", F.explode_outer("inputs").alias("input_table")).filter("input_table is not null")


@query("lin_table_list_text", STMTS + """
SELECT job_id, stmt_no, array_to_string(list_sort(inputs), ';') AS input_tables, array_to_string(list_sort(outputs), ';') AS output_tables FROM refs
""", ("f_jobs",))
def lin_table_list_text(spark, d):
    return T.table_refs(jobs_of(spark, d)).select(
        "job_id", "stmt_no", T.name_list(F.col("inputs")).alias("input_tables"), T.name_list(F.col("outputs")).alias("output_tables"))


@query("lin_table_edges", STMTS + "SELECT * FROM edges", ("f_jobs",))
def lin_table_edges(spark, d):
    return T.table_edges(due_refs(spark, d))


@query("lin_statement_errors", STMTS + """
SELECT job_id, stmt_no, CASE WHEN regexp_matches(stmt, '(?i)^use\\b') THEN 'database'
       WHEN len(inputs) = 0 AND len(outputs) = 0 THEN 'no table' WHEN len(outputs) = 0 THEN 'no output table'
       WHEN len(inputs) = 0 THEN 'no input table' ELSE 'ok' END AS status FROM refs
""", ("f_jobs",))
def lin_statement_errors(spark, d):
    return T.with_status(T.table_refs(jobs_of(spark, d))).select("job_id", "stmt_no", "status")


@query("lin_join_kinds", """
SELECT CASE c_custkey % 6 WHEN 0 THEN 'JOIN' WHEN 1 THEN 'LEFTOUTERJOIN' WHEN 2 THEN 'RIGHTOUTERJOIN'
       WHEN 3 THEN 'FULLOUTERJOIN' WHEN 4 THEN 'LEFTSEMIJOIN' ELSE 'JOIN' END AS kind, count(*) AS n FROM customer GROUP BY 1
""")
def lin_join_kinds(spark, d):
    return stmts_of(spark, d).select(F.explode(T.join_kinds()).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("lin_lateral_view_sources", """
SELECT stmt_id, unnest(list_distinct(regexp_extract_all(stmt, '(?i)\\b(?:from|join)\\s+([A-Za-z_][\\w.]*)', 1))) AS input_table
FROM f_stmts WHERE contains(stmt, 'lateral view')
""", ("f_stmts",))
def lin_lateral_view_sources(spark, d):
    viewed = stmts_of(spark, d).filter(F.rlike("stmt", F.lit(r"(?i)\blateral\s+view\b")))
    return viewed.select("stmt_id", F.explode(T.input_names()).alias("input_table"))


def shape_refs(spark, d):
    """Tables of the statements of ``f_shapes``."""
    return T.table_refs(use_all_cores(fixture(spark, d, "f_shapes")))


@query("lin_shape_tables", "SELECT id AS job_id, true_inputs AS inputs, true_outputs AS outputs FROM f_shapes", ("f_shapes",))
def lin_shape_tables(spark, d):
    """Every spelling of a statement against the tables it was made from."""
    return shape_refs(spark, d).select("job_id", T.name_list(F.col("inputs")).alias("inputs"), T.name_list(F.col("outputs")).alias("outputs"))


@query("lin_shape_with_names", "SELECT id AS job_id, true_with_names AS with_names FROM f_shapes", ("f_shapes",))
def lin_shape_with_names(spark, d):
    return T.statements(use_all_cores(fixture(spark, d, "f_shapes"))).select("job_id", T.name_list(T.cte_names()).alias("with_names"))


@query("lin_shape_edges", """
SELECT DISTINCT split_part(src, '.', 1) AS src_db, split_part(src, '.', 2) AS src_table, split_part(dst, '.', 1) AS dst_db, split_part(dst, '.', 2) AS dst_table
FROM (SELECT unnest(string_split(true_inputs, ';')) AS src, true_outputs FROM f_shapes) i, unnest(string_split(true_outputs, ';')) AS o(dst)
""", ("f_shapes",))
def lin_shape_edges(spark, d):
    return T.table_edges(shape_refs(spark, d))
