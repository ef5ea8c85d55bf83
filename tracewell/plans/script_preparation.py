"""Queries that turn scheduler scripts into runnable SQL texts."""
from pyspark.sql import functions as F

from tracewell.operators import scripts as S
from tracewell.registry import query
from tracewell.sources import fixture, table, use_all_cores

from .table_lineage import jobs_of


def scripts_of(spark, d):
    return use_all_cores(fixture(spark, d, "f_scripts"))


@query("src_jobs_scan", """
SELECT id, group_id, configs, run_type FROM f_jobs WHERE run_type IN ('hive', 'spark') AND auto = 1
""", ("f_jobs",))
def src_jobs_scan(spark, d):
    return S.scheduled_jobs(jobs_of(spark, d)).select("id", "group_id", "configs", "run_type")


@query("scr_config_json", """
SELECT id AS job_id, k AS key, json_extract_string(configs, concat('$."', k, '"')) AS value
FROM (SELECT id, configs, unnest(json_keys(configs)) AS k FROM f_jobs)
""", ("f_jobs",))
def scr_config_json(spark, d):
    return S.config_entries(jobs_of(spark, d), "job_id")


CHAIN = """
WITH RECURSIVE live AS (SELECT id, parent FROM f_job_groups WHERE existed = 1),
chain(group_id, ancestor_id, distance) AS (
  SELECT id, id, 0 FROM live
  UNION ALL
  SELECT c.group_id, p.id, c.distance + 1 FROM chain c JOIN live l ON l.id = c.ancestor_id JOIN live p ON p.id = l.parent
)"""

EFFECTIVE = CHAIN + """,
group_cfg AS (SELECT g.id, g.configs, unnest(json_keys(g.configs)) AS k FROM f_job_groups g WHERE existed = 1),
job_cfg AS (SELECT id, configs, unnest(json_keys(configs)) AS k FROM f_jobs),
every AS (
  SELECT id AS job_id, k AS key, json_extract_string(configs, concat('$."', k, '"')) AS value, -1 AS distance FROM job_cfg
  UNION ALL
  SELECT j.id, g.k, json_extract_string(g.configs, concat('$."', g.k, '"')), c.distance
  FROM f_jobs j JOIN chain c ON c.group_id = j.group_id JOIN group_cfg g ON g.id = c.ancestor_id
),
effective AS (
  SELECT job_id, key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, key ORDER BY distance) AS rn FROM every) WHERE rn = 1
)"""

FILLED = EFFECTIVE + """,
filled AS (
  SELECT j.id AS job_id, list_reduce(list_prepend(j.script, e.vars), lambda s, v:
           replace(s, concat('$', '{', split_part(v, chr(1), 1), '}'), split_part(v, chr(1), 2))) AS script
  FROM f_jobs j JOIN (SELECT job_id, list(concat(key, chr(1), value)) AS vars FROM effective GROUP BY job_id) e ON e.job_id = j.id
)"""


@query("scr_group_chain", CHAIN + """
SELECT j.id AS job_id, c.ancestor_id, c.distance FROM f_jobs j JOIN chain c ON c.group_id = j.group_id
""", ("f_jobs", "f_job_groups"))
def scr_group_chain(spark, d):
    jobs = jobs_of(spark, d).select(F.col("id").alias("job_id"), "group_id")
    chain = S.group_chain(fixture(spark, d, "f_job_groups"))
    return S.lookup_join(jobs, chain, ["group_id"], small=True).select("job_id", "ancestor_id", "distance")


def _effective(spark, d):
    return S.effective_settings(jobs_of(spark, d), fixture(spark, d, "f_job_groups"))


@query("scr_config_inherit", EFFECTIVE + " SELECT job_id, key, value FROM effective", ("f_jobs", "f_job_groups"))
def scr_config_inherit(spark, d):
    return _effective(spark, d).select(F.col("id").alias("job_id"), F.inline_outer("settings")).filter("key is not null")


@query("scr_substitute", FILLED + " SELECT job_id, script FROM filled", ("f_jobs", "f_job_groups"))
def scr_substitute(spark, d):
    return _effective(spark, d).select(F.col("id").alias("job_id"), S.substitute().alias("script"))


@query("scr_unresolved_vars", FILLED + """
SELECT job_id, unnest(list_distinct(regexp_extract_all(script, '\\$\\{[^}]*\\}'))) AS variable FROM filled
""", ("f_jobs", "f_job_groups"))
def scr_unresolved_vars(spark, d):
    filled = _effective(spark, d).select(F.col("id").alias("job_id"), S.substitute().alias("script"))
    return filled.select("job_id", F.explode(S.unresolved_variables()).alias("variable"))


MACRO_TEXTS = """
SELECT o_orderkey AS job_id, o_orderdate AS run_time,
       concat('insert overwrite table dw.t partition(dt=''$', '{zdt.addDay(-', o_orderkey % 9, ').format("yyyyMMdd")}'') select * from ods.s where day = ''$',
              '{zdt.addDay(', o_custkey % 5, ').format("yyyy-MM-dd")}'' and at < ''$',
              '{zdt.addDay(0).format("yyyy-MM-dd HH:mm:ss")}'' and pt = ''$', '{yesterday}''') AS script
FROM orders
"""


@query("scr_date_macro", """
SELECT o_orderkey AS job_id,
       concat('insert overwrite table dw.t partition(dt=''', strftime(o_orderdate - to_days(CAST(o_orderkey % 9 AS INT)), '%Y%m%d'),
              ''') select * from ods.s where day = ''', strftime(o_orderdate + to_days(CAST(o_custkey % 5 AS INT)), '%Y-%m-%d'),
              ''' and at < ''', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
              ''' and pt = ''', strftime(o_orderdate - to_days(1), '%Y%m%d'), '''') AS script
FROM orders
""")
def scr_date_macro(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return use_all_cores(spark.sql(MACRO_TEXTS)).select("job_id", S.render_dates("script", "run_time").alias("script"))


@query("scr_extract_hive_e", """
SELECT script_id, CAST(0 AS INT) AS call_no, regexp_extract(content, '-e\\s*"([^"]*)"', 1) AS sql_text
FROM f_scripts WHERE path LIKE '%.sh' AND regexp_matches(content, '-e\\s*"')
""", ("f_scripts",))
def scr_extract_hive_e(spark, d):
    return S.hive_commands(scripts_of(spark, d)).select("script_id", "call_no", "sql_text")


@query("scr_extract_python_sql", """
SELECT script_id, 'q' AS variable,
       replace(regexp_extract(content, 'q = \"\"\"([^"]*)\"\"\"', 1), '%(t)s', regexp_extract(content, 't = "([^"]*)"', 1)) AS sql_text
FROM f_scripts WHERE path LIKE '%.py' AND contains(content, 'runHiveCmd(q')
""", ("f_scripts",))
def scr_extract_python_sql(spark, d):
    return S.python_commands(scripts_of(spark, d)).select("script_id", "variable", "sql_text")


@query("scr_source_inline", """
SELECT s.script_id, s.path, concat(coalesce(i.content, ''), s.content) AS content, CAST(CASE WHEN i.path IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_missing
FROM f_scripts s LEFT JOIN f_includes i ON i.path = concat(regexp_extract(s.path, '^(.*/)', 1), 'vars.sh')
WHERE s.path LIKE '%.sh'
""", ("f_scripts", "f_includes"))
def scr_source_inline(spark, d):
    return S.inline_sources(scripts_of(spark, d), fixture(spark, d, "f_includes"))


@query("scr_shell_vars", """
SELECT script_id, replace(regexp_extract(content, '-e\\s*"([^"]*)"', 1), concat('$', 'tbl'), regexp_extract(content, 'tbl="([^"]*)"', 1)) AS filled_sql,
       CAST(0 AS INT) AS n_missing
FROM f_scripts WHERE path LIKE '%.sh'
""", ("f_scripts",))
def scr_shell_vars(spark, d):
    calls = S.fill_shell_variables(S.hive_commands(scripts_of(spark, d)))
    return calls.select("script_id", "filled_sql", F.size("missing").alias("n_missing"))
