"""Derived inputs: job, script, metadata and graph tables made from the given tables.

Every text runs unchanged on Spark and on the checking engine, so one definition
feeds both sides. ``$`` and ``{`` stay in separate literals because Spark fills
in ``${..}`` inside SQL text.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import TABLES, table

FIXTURES: dict[str, str] = {}

FIXTURES["f_job_groups"] = """
SELECT CAST(n_nationkey + 1 AS INT) AS id,
       CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE floor((n_nationkey + 1) / 2) END AS INT) AS parent,
       concat('{"env":"g', n_nationkey, '","region":"r', n_regionkey, '","lvl', n_nationkey % 3, '":"x"}') AS configs,
       CASE WHEN n_nationkey = 24 THEN 0 ELSE 1 END AS existed
FROM nation
"""

FIXTURES["f_jobs"] = """
SELECT p_partkey AS id,
       CAST(p_partkey % 24 + 1 AS INT) AS group_id,
       concat('{"limit":"', p_size, '"', CASE WHEN p_partkey % 3 = 0 THEN concat(',"env":"j', p_size % 5, '"') ELSE '' END, '}') AS configs,
       CASE WHEN p_partkey % 7 = 0 THEN 'shell' WHEN p_partkey % 2 = 0 THEN 'hive' ELSE 'spark' END AS run_type,
       CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS auto,
       concat('use db_', p_size % 6, ';', chr(10),
              '-- from ods.commented_out ', p_name, chr(10),
              'set hive.x=1;', chr(10),
              'with t1 as (select k from ods.src_', CAST(floor(p_partkey / 4) AS BIGINT), ')', chr(10),
              'insert overwrite table dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT), chr(10),
              'select a.k, nvl(b.v,0) as v from t1 a left outer join dim_', p_size % 10, ' b on a.k = b.k',
              ' where b.v > $', '{limit} and b.env = ''$', '{env}'' and b.pt = ''$', '{yesterday}'';', chr(10),
              'insert into table rpt_', CAST(floor(p_partkey / 9) AS BIGINT), ' select k, v from dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT), chr(10),
              'union all', chr(10),
              'select k, v from ods.src_', CAST(floor((p_partkey + 17) / 4) AS BIGINT), ';', chr(10)) AS script
FROM part
"""

# The warehouse's metadata. Every name that the scripts use is derived from all
# parts, but every 17th source and every 19th report has no metadata; sources named
# after suppliers are used by no script. Ids follow from the names.
FIXTURES["f_meta_table"] = """
SELECT CAST(4 * n AS INT) AS table_id, 'ods' AS database_name, concat('src_', n) AS table_name
FROM (SELECT DISTINCT CAST(floor(p_partkey / 4) AS BIGINT) AS n FROM part) s WHERE n % 17 <> 3
UNION ALL SELECT CAST(4 * (100000000 + s_suppkey) AS INT), 'ods', concat('spare_', s_suppkey) FROM supplier
UNION ALL SELECT CAST(4 * n + 1 AS INT), 'dw', concat('dst_', n) FROM (SELECT DISTINCT CAST(floor(p_partkey / 7) AS BIGINT) AS n FROM part) d
UNION ALL SELECT CAST(4 * (10 * db + n) + 2 AS INT), concat('db_', db), concat('dim_', n) FROM (SELECT DISTINCT p_size % 6 AS db, p_size % 10 AS n FROM part) m
UNION ALL SELECT CAST(4 * (6 * n + db) + 3 AS INT), concat('db_', db), concat('rpt_', n)
FROM (SELECT DISTINCT p_size % 6 AS db, CAST(floor(p_partkey / 9) AS BIGINT) AS n FROM part) r WHERE n % 19 <> 5
"""

FIXTURES["f_meta_column"] = """
SELECT CAST(table_id AS BIGINT) * 3 + ordinal AS column_id, column_name, table_id, table_name, database_name, ordinal
FROM f_meta_table CROSS JOIN (SELECT 1 AS ordinal, 'k' AS column_name UNION ALL SELECT 2, 'v' UNION ALL SELECT 3, 'pt') c
"""

# An older snapshot of the metadata: some tables and columns are missing, some
# columns have gone since.
FIXTURES["f_meta_column_old"] = """
SELECT column_id, column_name, table_id, table_name, database_name, ordinal FROM f_meta_column
WHERE table_id % 13 <> 0 AND NOT (table_id % 17 = 0 AND column_name = 'v')
UNION ALL
SELECT 10000000000 + column_id, 'retired', table_id, table_name, database_name, 4 FROM f_meta_column
WHERE table_id % 11 = 0 AND table_id % 13 <> 0 AND ordinal = 3
"""

# A warehouse that grows with the parts, and how it looked before: tables of ten
# columns, some missing on either side, some of another type.
FIXTURES["f_wide_columns"] = """
SELECT concat('db_', CAST(floor(p_partkey / 10) AS BIGINT) % 6) AS database_name, concat('t_', CAST(floor(p_partkey / 10) AS BIGINT)) AS table_name,
       concat('c_', p_partkey % 10) AS column_name, CASE WHEN p_size % 7 = 0 THEN 'bigint' WHEN p_size % 2 = 0 THEN 'double' ELSE 'string' END AS data_type
FROM part WHERE p_partkey % 11 <> 0
"""

FIXTURES["f_wide_columns_old"] = """
SELECT concat('db_', CAST(floor(p_partkey / 10) AS BIGINT) % 6) AS database_name, concat('t_', CAST(floor(p_partkey / 10) AS BIGINT)) AS table_name,
       concat('c_', p_partkey % 10) AS column_name, CASE WHEN p_size % 7 = 0 THEN 'int' WHEN p_size % 2 = 0 THEN 'double' ELSE 'string' END AS data_type
FROM part WHERE p_partkey % 13 <> 0
"""

FIXTURES["f_col_lines"] = """
SELECT p_partkey AS stmt_id, 1 AS branch, 1 AS pos, 'k' AS to_name, concat('ods.src_', CAST(floor(p_partkey / 4) AS BIGINT), '.k') AS expr,
       concat('ods.src_', CAST(floor(p_partkey / 4) AS BIGINT), '.k') AS from_names, concat('dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT)) AS to_table,
       concat('WHERE:b.v > ', p_size) AS cond FROM part
UNION ALL
SELECT p_partkey, 1, 2, 'v', concat('nvl(db_', p_size % 6, '.dim_', p_size % 10, '.v,0)'), concat('db_', p_size % 6, '.dim_', p_size % 10, '.v'),
       concat('dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT)), concat('LEFTOUTERJOIN:a.k = b.k and b.size = ', p_size) FROM part
UNION ALL
SELECT p_partkey, 2, 2, '', '0', '0', concat('dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT)), concat('WHERE:b.v > ', p_size) FROM part WHERE p_partkey % 4 = 0
"""

FIXTURES["f_table_edges"] = """
SELECT DISTINCT 'ods' AS src_db, r_name AS src_table, 'dim' AS dst_db, n_name AS dst_table FROM region JOIN nation ON r_regionkey = n_regionkey
UNION ALL SELECT DISTINCT 'dim', n_name, 'dwd', concat('supp_', s_suppkey) FROM nation JOIN supplier ON n_nationkey = s_nationkey
UNION ALL SELECT DISTINCT 'dwd', concat('supp_', l_suppkey), 'dws', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
"""

FIXTURES["f_event_flow"] = """
SELECT DISTINCT 'app' AS src_db, event_type AS src_table, 'app' AS dst_db, nxt AS dst_table FROM (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) t
WHERE nxt IS NOT NULL AND nxt <> event_type
"""

FIXTURES["f_tasks"] = """
SELECT o_orderkey AS id, concat('task_', o_orderkey) AS name, concat('/app/', o_orderstatus) AS app_path,
       concat('main_', o_orderkey % 100, '.sh -x arg') AS main_class, o_custkey AS user_id,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS state,
       CASE WHEN o_orderkey % 3 = 0 THEN 'SHELL' WHEN o_orderkey % 3 = 1 THEN 'HIVE' ELSE 'MR' END AS type,
       o_orderdate AS update_date
FROM orders
"""

FIXTURES["f_scripts"] = """
SELECT o_orderkey AS script_id, concat('/jobs/d', o_orderkey % 5, '/s', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '.sh' ELSE '.py' END) AS path,
       CASE WHEN o_orderkey % 2 = 0 THEN
         concat('source vars.sh', chr(10), 'tbl="ods.o_', CAST(floor(o_custkey / 3) AS BIGINT), '"', chr(10),
                'hive -e "insert into table dw.s_', CAST(floor(o_orderkey / 30) AS BIGINT), ' select * from $', 'tbl ;"', chr(10))
       ELSE
         concat('t = "ods.o_', CAST(floor(o_custkey / 3) AS BIGINT), '"', chr(10), 'q = \"\"\"insert into table dw.s_', CAST(floor(o_orderkey / 30) AS BIGINT), ' select * from %(t)s ;\"\"\"', chr(10), 'runHiveCmd(q, 1)', chr(10))
       END AS content
FROM orders
"""

# One shared include per script folder, the file the shell scripts source.
FIXTURES["f_includes"] = """
SELECT concat('/jobs/d', r_regionkey, '/vars.sh') AS path,
       concat('region="', lower(r_name), '"', chr(10)) AS content
FROM region
"""

# Statements with the shapes a flat select can take: aliases, stars, computed
# columns, CASE, map and array access, lateral views and all the join spellings.
FIXTURES["f_stmts"] = """
SELECT c_custkey AS stmt_id, concat('dw.cust_', CAST(floor(c_custkey / 8) AS BIGINT)) AS target,
       concat('insert overwrite table dw.cust_', CAST(floor(c_custkey / 8) AS BIGINT), chr(10),
              'select a.k, coalesce(a.v, b.v, ', c_nationkey, ') as v, ',
              'case when a.pt = ''x,y'' then b.k when b.pt > ', c_nationkey, ' then a.v else 0 end as picked, ',
              'a.props[''lang''] as lang, b.items[0] as item, ', c_nationkey, ' as fixed, concat(a.k, ''-'', b.pt) tag', chr(10),
              'from ods.src_', CAST(floor(c_custkey / 5) AS BIGINT), ' a ',
              CASE c_custkey % 6 WHEN 0 THEN 'join' WHEN 1 THEN 'left outer join' WHEN 2 THEN 'right outer join'
                   WHEN 3 THEN 'full outer join' WHEN 4 THEN 'left semi join' ELSE 'inner join' END,
              ' dw.dst_', CAST(floor(c_custkey / 6) AS BIGINT), ' b on a.k = b.k',
              CASE WHEN c_custkey % 4 = 0 THEN ' lateral view explode(b.items) ex as one' ELSE '' END,
              ' where a.v > ', c_nationkey, ' and b.pt <> ''', c_mktsegment, '''') AS stmt
FROM customer
"""

# One statement per customer in one of many spellings, with the tables it truly
# reads and writes; nothing here is found by a pattern.
FIXTURES["f_shapes"] = """
SELECT c_custkey AS id, c_custkey % 16 AS shape,
       CASE c_custkey % 16
         WHEN 0 THEN concat('insert into dw.d_', c_custkey, ' select x.k, y.v from ods.a_', c_custkey, ' x, ods.b_', c_custkey, ' y where x.k = y.k')
         WHEN 1 THEN concat('create external table dw.d_', c_custkey, ' as select k from ods.a_', c_custkey)
         WHEN 2 THEN concat('CREATE TEMPORARY TABLE dw.d_', c_custkey, ' AS SELECT k FROM ods.a_', c_custkey)
         WHEN 3 THEN concat('insert overwrite table `dw`.`d_', c_custkey, '` select k from `ods`.`a_', c_custkey, '` t join `ods`.b_', c_custkey, ' u on t.k = u.k')
         WHEN 4 THEN concat('insert into table dw.d_', c_custkey, ' select extract(year from ts) as y, trim(both from n) from ods.a_', c_custkey)
         WHEN 5 THEN concat('insert into table dw.d_', c_custkey, ' select k -- from ods.gone', chr(10), '/* join ods.gone2 */ from ods.a_', c_custkey)
         WHEN 6 THEN concat('insert into table dw.d_', c_custkey, ' select ''copied from here'' as c, "join there" as e from ods.a_', c_custkey)
         WHEN 7 THEN concat('with p as (select k from ods.a_', c_custkey, '),q as (select k from ods.b_', c_custkey, ') insert into dw.d_', c_custkey, ' select * from P join Q on p.k = q.k')
         WHEN 8 THEN concat('with t', c_custkey, ' as (select k from t', c_custkey, ') insert into dw.d_', c_custkey, ' select k from t', c_custkey)
         WHEN 9 THEN concat('insert into table dw.d_', c_custkey, ' select split(v, '';'') as p from ods.a_', c_custkey)
         WHEN 10 THEN concat('from ods.a_', c_custkey, ' t insert overwrite table dw.d_', c_custkey, ' select t.k insert overwrite table dw.e_', c_custkey, ' select t.v')
         WHEN 11 THEN concat('insert into table dw.d_', c_custkey, ' select q.s from (select t.v as s from ods.a_', c_custkey, ' t) q join ods.b_', c_custkey, ' b on q.s = b.s')
         WHEN 12 THEN concat('insert into table dw.d_', c_custkey, ' select k from ods.a_', c_custkey, ' order by k, v')
         WHEN 13 THEN concat('insert into table dw.d_', c_custkey, ' select k, ''it', chr(92), '''s from x'' from ods.a_', c_custkey, ' as t, ods.b_', c_custkey, ', ods.c_', c_custkey, ' u')
         WHEN 14 THEN concat('insert into table dw.d_', c_custkey, ' select k from ods.a_', c_custkey, ' union all select k from ods.b_', c_custkey)
         ELSE concat('create table if not exists dw.d_', c_custkey, ' as select a.k from ods.a_', c_custkey, ' a left join ods.b_', c_custkey, ' b on a.k = b.k') END AS script,
       CASE WHEN c_custkey % 16 = 8 THEN concat('default.t', c_custkey)
            WHEN c_custkey % 16 = 13 THEN concat('ods.a_', c_custkey, ';ods.b_', c_custkey, ';ods.c_', c_custkey)
            WHEN c_custkey % 16 IN (0, 3, 7, 11, 14, 15) THEN concat('ods.a_', c_custkey, ';ods.b_', c_custkey) ELSE concat('ods.a_', c_custkey) END AS true_inputs,
       CASE WHEN c_custkey % 16 = 10 THEN concat('dw.d_', c_custkey, ';dw.e_', c_custkey) ELSE concat('dw.d_', c_custkey) END AS true_outputs,
       CASE c_custkey % 16 WHEN 7 THEN 'p;q' WHEN 8 THEN concat('t', c_custkey) ELSE '' END AS true_with_names
FROM customer
"""

# Expressions with words, types, frames and literals that are no columns, and the
# columns they truly read.
FIXTURES["f_expressions"] = """
SELECT c_custkey AS id, n AS shape,
       CASE n WHEN 0 THEN concat('cast(t.v', c_custkey, ' as string)') WHEN 1 THEN concat('cast(k', c_custkey, ' as decimal(10, 2)) + 1e5')
              WHEN 2 THEN concat('sum(a.v', c_custkey, ') over (partition by a.g order by a.d rows between unbounded preceding and current row)')
              WHEN 3 THEN concat('if(x', c_custkey, ' > date ''2020-01-01'', "lit", ''it', chr(92), '''s b'')') WHEN 4 THEN concat('extract(year from ts', c_custkey, ')')
              WHEN 5 THEN concat('`t`.`c', c_custkey, '` + interval 3 day') WHEN 6 THEN concat('case when a.x = 1.5e-3 then b', c_custkey, ' else 0x1F end')
              ELSE concat('cast(m', c_custkey, '[''k''] as array<string>)') END AS expr,
       CASE n WHEN 0 THEN concat('t.v', c_custkey) WHEN 1 THEN concat('k', c_custkey) WHEN 2 THEN concat('a.v', c_custkey, ';a.g;a.d') WHEN 3 THEN concat('x', c_custkey)
              WHEN 4 THEN concat('ts', c_custkey) WHEN 5 THEN concat('t.c', c_custkey) WHEN 6 THEN concat('a.x;b', c_custkey) ELSE concat('m', c_custkey) END AS true_columns
FROM (SELECT c_custkey, c_custkey % 8 AS n FROM customer) c
"""

# Column references as written in a statement: an alias (or none) and a column.
FIXTURES["f_col_refs"] = """
SELECT p_partkey AS stmt_id, 1 AS pos, 'a' AS alias, 'k' AS column_name FROM part
UNION ALL SELECT p_partkey, 2, 'b', 'v' FROM part
UNION ALL SELECT p_partkey, 3, '', CASE p_partkey % 3 WHEN 0 THEN 'pt' WHEN 1 THEN 'k' ELSE 'gone' END FROM part
UNION ALL SELECT p_partkey, 4, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE '' END, '*' FROM part WHERE p_partkey % 5 = 0
"""

# Tables in the scope of a statement; every other one names a table without metadata second.
FIXTURES["f_scope_tables"] = """
SELECT p_partkey AS stmt_id, 'a' AS alias, 'ods' AS database_name, concat('src_', CAST(floor(p_partkey / 4) AS BIGINT)) AS table_name, 1 AS place FROM part
UNION ALL SELECT p_partkey, 'b', CASE WHEN p_partkey % 2 = 0 THEN concat('db_', p_size % 6) ELSE 'tmp' END, concat('dim_', p_size % 10), 2 FROM part
"""

# Nested query scopes, up to five levels; the innermost one reads a base table
# and the second one joins another.
FIXTURES["f_scopes"] = """
SELECT o_orderkey AS stmt_id, lvl AS scope_id, lvl - 1 AS parent_id, CAST(o_orderkey % 5 + 1 AS INT) AS depth,
       CASE WHEN lvl % 3 = 2 THEN '' ELSE concat('q', lvl) END AS alias, o_custkey AS custkey
FROM orders CROSS JOIN (SELECT 1 AS lvl UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) n
WHERE lvl <= o_orderkey % 5 + 1
"""

FIXTURES["f_scope_columns"] = """
SELECT stmt_id, scope_id, 'c' AS column_name,
       CASE WHEN scope_id < depth THEN scope_id + 1 END AS child_scope_id,
       CASE WHEN scope_id = depth THEN concat('ods.part_', custkey % 40, '.c') END AS source,
       CASE WHEN scope_id % 2 = 0 THEN concat('WHERE:c > ', scope_id) END AS cond
FROM f_scopes
UNION ALL
SELECT stmt_id, 2, 'c', CAST(NULL AS INT), concat('dim.d_', custkey % 7, '.c'), 'JOIN:a.c = b.c' FROM f_scopes WHERE scope_id = 2
"""


def _needs(name: str) -> list[str]:
    """Derived views a text reads, in the order they were defined."""
    return [other for other in FIXTURES if other != name and re.search(rf"\b{other}\b", FIXTURES[name])]


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in (*_closure(tuple(_needs(name))), name):
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def with_fixtures(sql: str, *names: str) -> str:
    """SQL text with the derived views it reads put in front."""
    if not names:
        return sql.strip()
    views = ",\n".join(f"{name} AS ({FIXTURES[name].strip()})" for name in _closure(names))
    return f"WITH {views}\nSELECT * FROM (\n{sql.strip()}\n) AS result"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a frame."""
    text = FIXTURES[name]
    for source in TABLES:
        if re.search(rf"\b{source}\b", text):
            table(spark, sf_dir, source).createOrReplaceTempView(source)
    for needed in _needs(name):
        fixture(spark, sf_dir, needed).createOrReplaceTempView(needed)
    return spark.sql(text)
