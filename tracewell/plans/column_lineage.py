"""Queries from statements to select items, column references and column edges."""
from pyspark.sql import functions as F

from tracewell.operators import columns as C
from tracewell.operators import metadata as M
from tracewell.operators import relations as R
from tracewell.operators import scripts as P
from tracewell.operators import scopes as S
from tracewell.operators import statements as T
from tracewell.registry import query
from tracewell.sources import fixture
from tracewell.storage import scratch_path

from .table_lineage import STMTS, due_refs, jobs_of, shape_refs, stmts_of

WORDS = "[" + ", ".join(f"'{w}'" for w in C.SQL_WORDS) + "]"

# Statement text -> scopes -> items, for any view ``s(stmt_key, stmt)``.
ITEMS = """
bodies AS (
  SELECT key, unnest(list_concat(
    list_transform(list_zip(regexp_extract_all(stmt, '(?is)(?:\\bwith|,)\\s*(\\w+)\\s+as\\s*\\(((?:[^()]|\\([^()]*\\))*)\\)', 1),
                            regexp_extract_all(stmt, '(?is)(?:\\bwith|,)\\s*(\\w+)\\s+as\\s*\\(((?:[^()]|\\([^()]*\\))*)\\)', 2)),
                   lambda z: {'scope': z[1], 'body': z[2]}),
    [{'scope': '', 'body': regexp_replace(stmt, '(?is)(?:\\bwith|,)\\s*(\\w+)\\s+as\\s*\\(((?:[^()]|\\([^()]*\\))*)\\)', ' ', 'g')}])) AS b FROM s),
branches AS (
  SELECT key, b.scope AS scope, CAST(unnest(range(len(string_split_regex(b.body, '(?i)\\bunion(?:\\s+all|\\s+distinct)?\\b')))) AS INT) AS branch,
         unnest(string_split_regex(b.body, '(?i)\\bunion(?:\\s+all|\\s+distinct)?\\b')) AS text FROM bodies),
scopes AS (SELECT key, scope, branch, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM branches WHERE regexp_matches(text, '(?i)\\bselect\\b')),
lists AS (
  SELECT key, scope, branch, regexp_extract_all(regexp_extract(text, '(?is)\\bselect\\s+(?:distinct\\s+)?(.*?)\\s+from\\s', 1),
         '((?:[^,()'']|''[^'']*''|\\((?:[^()'']|''[^'']*''|\\([^()]*\\))*\\))+)', 1) AS items FROM scopes),
raw_items AS (
  SELECT key, scope, branch, CAST(unnest(range(len(items))) AS INT) AS pos, trim(unnest(items)) AS item FROM lists),
named AS (
  SELECT *, regexp_extract(item, '(?is)^(.*\\S)\\s+as\\s+(\\w+)$', 2) AS by_as, regexp_extract(item, '(?is)^(.*[\\w)\\]''])\\s+(\\w+)$', 2) AS by_space FROM raw_items),
items AS (
  SELECT key, scope, branch, pos,
    CASE WHEN by_as <> '' THEN regexp_extract(item, '(?is)^(.*\\S)\\s+as\\s+(\\w+)$', 1)
         WHEN by_space <> '' AND NOT list_contains(WORDS, lower(by_space)) THEN regexp_extract(item, '(?is)^(.*[\\w)\\]''])\\s+(\\w+)$', 1) ELSE item END AS expr,
    CASE WHEN by_as <> '' THEN by_as WHEN by_space <> '' AND NOT list_contains(WORDS, lower(by_space)) THEN by_space
         ELSE regexp_extract(item, '^(?:\\w+\\.)*([A-Za-z_]\\w*)$', 1) END AS name FROM named),
found AS (
  SELECT key, scope, branch, pos, expr, name, regexp_extract_all(regexp_replace(expr, '''[^'']*''', '''''', 'g'),
         '[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)*(?:\\s*\\()?') AS hits FROM items),
refs_of AS (
  SELECT key, scope, branch, pos, expr, name, list_distinct(list_filter(hits, lambda h: NOT contains(h, '(') AND NOT list_contains(WORDS, lower(h)))) AS refs FROM found)
""".replace("WORDS", WORDS)

JOB_ITEMS = STMTS.rstrip() + ",\ns AS (SELECT {'job_id': job_id, 'stmt_no': stmt_no} AS key, stmt FROM stmts),\n" + ITEMS
STMT_ITEMS = "WITH s AS (SELECT stmt_id AS key, stmt FROM f_stmts),\n" + ITEMS


def job_scopes(spark, d):
    return C.scopes(T.statements(jobs_of(spark, d)), "job_id", "stmt_no")


def stmt_scopes(spark, d):
    return C.scopes(stmts_of(spark, d), "stmt_id")


def stmt_items(spark, d):
    return C.select_items(stmt_scopes(spark, d), "stmt_id")


@query("lin_select_items", JOB_ITEMS + """
SELECT key.job_id AS job_id, key.stmt_no AS stmt_no, scope, branch, pos, expr, name FROM items
""", ("f_jobs",))
def lin_select_items(spark, d):
    return C.select_items(job_scopes(spark, d), "job_id", "stmt_no")


@query("lin_column_refs", JOB_ITEMS + """
SELECT key.job_id AS job_id, key.stmt_no AS stmt_no, scope, branch, pos, unnest(refs) AS ref FROM refs_of
""", ("f_jobs",))
def lin_column_refs(spark, d):
    items = C.select_items(job_scopes(spark, d), "job_id", "stmt_no")
    return items.select("job_id", "stmt_no", "scope", "branch", "pos", F.explode(C.column_refs()).alias("ref"))


@query("lin_multi_table_expr", STMT_ITEMS + """
SELECT key AS stmt_id, pos, array_to_string(list_sort(list_distinct(list_transform(refs, lambda r: split_part(r, '.', 1)))), ';') AS aliases,
       array_to_string(list_sort(refs), ';') AS refs
FROM refs_of WHERE len(list_distinct(list_transform(refs, lambda r: split_part(r, '.', 1)))) > 1
""", ("f_stmts",))
def lin_multi_table_expr(spark, d):
    refs = stmt_items(spark, d).withColumn("refs", C.column_refs())
    aliases = F.array_distinct(F.transform("refs", lambda r: F.substring_index(r, ".", 1)))
    return (refs.withColumn("aliases", aliases).filter(F.size("aliases") > 1)
            .select("stmt_id", "pos", T.name_list(F.col("aliases")).alias("aliases"), T.name_list(F.col("refs")).alias("refs")))


@query("lin_case_sources", STMT_ITEMS + """
SELECT key AS stmt_id, name, unnest(refs) AS source FROM refs_of WHERE regexp_matches(expr, '(?i)^case\\b')
""", ("f_stmts",))
def lin_case_sources(spark, d):
    cases = stmt_items(spark, d).filter(F.rlike("expr", F.lit(r"(?i)^case\b")))
    return cases.select("stmt_id", "name", F.explode(C.column_refs()).alias("source"))


@query("lin_collection_access", STMT_ITEMS + """
SELECT key AS stmt_id, name, expr, regexp_extract(expr, '^([\\w.]+)\\[', 1) AS source FROM items WHERE contains(expr, '[')
""", ("f_stmts",))
def lin_collection_access(spark, d):
    access = stmt_items(spark, d).filter(F.contains("expr", F.lit("[")))
    return access.select("stmt_id", "name", "expr", F.explode(C.column_refs()).alias("source"))


@query("lin_conditions", STMT_ITEMS + """,
conds AS (
  SELECT stmt_id, concat(CASE stmt_id % 6 WHEN 0 THEN 'JOIN' WHEN 1 THEN 'LEFTOUTERJOIN' WHEN 2 THEN 'RIGHTOUTERJOIN' WHEN 3 THEN 'FULLOUTERJOIN'
         WHEN 4 THEN 'LEFTSEMIJOIN' ELSE 'JOIN' END, ':', trim(regexp_extract(regexp_replace(stmt, '\\s+', ' ', 'g'), ' on (.*?)(?: lateral view | where )', 1))) AS cond FROM f_stmts
  UNION ALL
  SELECT stmt_id, concat('WHERE:', trim(regexp_extract(regexp_replace(stmt, '\\s+', ' ', 'g'), ' where (.*)$', 1))) FROM f_stmts)
SELECT i.key AS stmt_id, i.name, c.cond FROM items i JOIN conds c ON c.stmt_id = i.key
""", ("f_stmts",))
def lin_conditions(spark, d):
    scoped = stmt_scopes(spark, d).withColumn("conds", C.conditions())
    named = C.select_items(scoped, "stmt_id", "conds")
    return named.select("stmt_id", "name", F.explode_outer("conds").alias("cond")).filter("cond is not null")


@query("lin_colfun", STMT_ITEMS + """
SELECT key AS stmt_id, name, CASE WHEN len(list_filter(string_split(expr, '&'), lambda p: NOT list_contains(refs, p))) > 0 THEN concat('COLFUN:', expr) ELSE '' END AS colfun
FROM refs_of
""", ("f_stmts",))
def lin_colfun(spark, d):
    items = stmt_items(spark, d).withColumn("refs", C.column_refs())
    return items.select("stmt_id", "name", F.when(C.is_computed("expr", F.col("refs")), F.concat(F.lit("COLFUN:"), "expr")).otherwise("").alias("colfun"))


@query("lin_expression_columns", "SELECT id, shape, true_columns AS columns FROM f_expressions", ("f_expressions",))
def lin_expression_columns(spark, d):
    """Columns of expressions with casts, frames, literals and numbers, against those they were made from."""
    return fixture(spark, d, "f_expressions").select("id", "shape", F.array_join(C.column_refs(), ";").alias("columns"))


REFS = ("f_col_refs", "f_scope_tables", "f_meta_column")


@query("lin_alias_resolve", """
SELECT r.stmt_id, r.pos, r.column_name, t.database_name, t.table_name
FROM f_col_refs r LEFT JOIN f_scope_tables t ON t.stmt_id = r.stmt_id AND t.alias = r.alias WHERE r.alias <> ''
UNION ALL
SELECT r.stmt_id, r.pos, r.column_name, t.database_name, t.table_name
FROM f_col_refs r JOIN f_scope_tables t ON t.stmt_id = r.stmt_id WHERE r.alias = '' AND r.column_name <> '*'
""", REFS)
def lin_alias_resolve(spark, d):
    refs, sources = fixture(spark, d, "f_col_refs"), fixture(spark, d, "f_scope_tables")
    keep = ["stmt_id", "pos", "column_name", "database_name", "table_name"]
    named = C.resolve_aliases(refs.filter("alias <> ''"), sources).select(*keep)
    return named.unionByName(C.candidate_tables(refs, sources).select(*keep))


@query("lin_star_expand", """
SELECT r.stmt_id, r.pos, t.place, c.ordinal, t.database_name, t.table_name, c.column_name
FROM f_col_refs r JOIN f_scope_tables t ON t.stmt_id = r.stmt_id AND (r.alias = '' OR r.alias = t.alias)
JOIN f_meta_column c ON c.database_name = t.database_name AND c.table_name = t.table_name WHERE r.column_name = '*'
""", REFS)
def lin_star_expand(spark, d):
    return C.expand_stars(fixture(spark, d, "f_col_refs"), fixture(spark, d, "f_scope_tables"), fixture(spark, d, "f_meta_column"))


OWNERS = """
WITH hits AS (
  SELECT r.stmt_id, r.pos, r.column_name, list_sort(list(DISTINCT concat(t.database_name, '.', t.table_name))) AS owners
  FROM f_col_refs r JOIN f_scope_tables t ON t.stmt_id = r.stmt_id
  JOIN f_meta_column c ON c.database_name = t.database_name AND c.table_name = t.table_name AND lower(c.column_name) = lower(r.column_name)
  WHERE r.alias = '' AND r.column_name <> '*' GROUP BY ALL)
"""


def _owners(spark, d):
    return C.bind_bare(fixture(spark, d, "f_col_refs"), fixture(spark, d, "f_scope_tables"), fixture(spark, d, "f_meta_column"))


@query("lin_bare_column_bind", OWNERS + "SELECT stmt_id, pos, column_name, owners[1] AS owner FROM hits WHERE len(owners) = 1", REFS)
def lin_bare_column_bind(spark, d):
    return _owners(spark, d).filter(F.size("owners") == 1).select("stmt_id", "pos", "column_name", F.get("owners", F.lit(0)).alias("owner"))


@query("lin_ambiguous_columns", OWNERS + "SELECT stmt_id, pos, column_name, array_to_string(owners, ';') AS owners FROM hits WHERE len(owners) > 1", REFS)
def lin_ambiguous_columns(spark, d):
    return _owners(spark, d).filter(F.size("owners") > 1).select("stmt_id", "pos", "column_name", F.array_join("owners", ";").alias("owners"))


@query("lin_subquery_collapse", """
WITH RECURSIVE walk(stmt_id, column_name, child_scope_id, source, conds) AS (
  SELECT stmt_id, column_name, child_scope_id, source, list_filter([cond], lambda c: c IS NOT NULL) FROM f_scope_columns WHERE scope_id = 1
  UNION ALL
  SELECT w.stmt_id, w.column_name, n.child_scope_id, n.source, list_concat(w.conds, list_filter([n.cond], lambda c: c IS NOT NULL))
  FROM walk w JOIN f_scope_columns n ON n.stmt_id = w.stmt_id AND n.scope_id = w.child_scope_id AND n.column_name = w.column_name)
SELECT stmt_id, column_name, source, array_to_string(list_sort(list_distinct(conds)), ';') AS conds FROM walk WHERE child_scope_id IS NULL
""", ("f_scope_columns",))
def lin_subquery_collapse(spark, d):
    return C.collapse_scopes(fixture(spark, d, "f_scope_columns")).withColumn("conds", F.array_join("conds", ";"))


@query("lin_scope_children", """
SELECT s.stmt_id, s.scope_id, coalesce((SELECT string_agg(CAST(c.scope_id AS VARCHAR), ';' ORDER BY c.scope_id) FROM f_scopes c WHERE c.stmt_id = s.stmt_id AND c.parent_id = s.scope_id), '') AS children,
       coalesce((SELECT max_by(a.alias, a.scope_id) FROM f_scopes a WHERE a.stmt_id = s.stmt_id AND a.scope_id < s.scope_id AND a.alias <> ''), '') AS nearest_named
FROM f_scopes s
""", ("f_scopes",))
def lin_scope_children(spark, d):
    return C.scope_children(fixture(spark, d, "f_scopes")).withColumn("children", F.array_join("children", ";"))


MERGED = """
WITH merged AS (
  SELECT stmt_id, pos, to_table, coalesce(first(to_name ORDER BY branch) FILTER (to_name <> ''), '') AS to_name, string_agg(expr, '&' ORDER BY branch) AS expr,
         list_sort(list(DISTINCT from_names)) AS from_names, list_sort(list(DISTINCT cond)) AS conditions
  FROM f_col_lines GROUP BY stmt_id, pos, to_table)
"""


def merged_lines(spark, d):
    return C.merge_union_branches(fixture(spark, d, "f_col_lines"))


@query("lin_union_merge", MERGED + """
SELECT stmt_id, pos, to_table, to_name, expr, array_to_string(from_names, ';') AS from_names, array_to_string(conditions, ';') AS conditions FROM merged
""", ("f_col_lines",))
def lin_union_merge(spark, d):
    return merged_lines(spark, d).withColumn("from_names", F.array_join("from_names", ";")).withColumn("conditions", F.array_join("conditions", ";"))


@query("lin_union_check", """
WITH b AS (SELECT stmt_id, branch, count(*) AS n, min(to_table) AS lo, max(to_table) AS hi FROM f_col_lines GROUP BY ALL)
SELECT stmt_id, count(*) AS n_branches, min(n) AS min_columns, max(n) AS max_columns, min(lo) <> max(hi) AS targets_differ
FROM b GROUP BY stmt_id HAVING min(n) <> max(n) OR min(lo) <> max(hi)
""", ("f_col_lines",))
def lin_union_check(spark, d):
    return C.branch_mismatch(fixture(spark, d, "f_col_lines"))


@query("lin_condition_map", """
SELECT stmt_id, split_part(cond, ':', 1) AS kind, array_to_string(list_sort(list(DISTINCT substr(cond, instr(cond, ':') + 1))), ';') AS texts
FROM f_col_lines GROUP BY ALL
""", ("f_col_lines",))
def lin_condition_map(spark, d):
    return C.condition_map(fixture(spark, d, "f_col_lines"), "stmt_id").withColumn("texts", F.array_join("texts", ";"))


NAMED = MERGED.rstrip() + """,
widths AS (SELECT concat(database_name, '.', table_name) AS to_table, count(*) AS n_meta FROM f_meta_column GROUP BY 1),
named AS (
  SELECT m.stmt_id, m.pos, m.to_table, m.to_name, array_to_string(m.from_names, '&') AS from_names, m.conditions,
         CASE WHEN m.n_lines = w.n_meta THEN c.column_name ELSE m.to_name END AS out_name
  FROM (SELECT *, count(*) OVER (PARTITION BY stmt_id, to_table) AS n_lines FROM merged) m
  LEFT JOIN widths w ON w.to_table = m.to_table
  LEFT JOIN f_meta_column c ON concat(c.database_name, '.', c.table_name) = m.to_table AND c.ordinal = m.pos),
edges AS (
  SELECT stmt_id, unnest(string_split(from_names, '&')) AS src, concat(to_table, '.', out_name) AS dst, conditions FROM named),
col_edges AS (SELECT * FROM edges WHERE len(string_split(src, '.')) = 3)
"""


# Two-column metadata for half of the targets, so that positions decide there.
NARROW = "f_meta_column WHERE NOT (database_name = 'dw' AND ordinal = 3 AND table_id % 8 = 1)"


def named_lines(spark, d):
    meta = fixture(spark, d, "f_meta_column").filter("NOT (database_name = 'dw' AND ordinal = 3 AND table_id % 8 = 1)")
    lines = merged_lines(spark, d).withColumn("from_names", F.array_join("from_names", "&"))
    return C.positional_names(lines, meta)


def _narrow(sql):
    return sql.replace("FROM f_meta_column GROUP", f"FROM (SELECT * FROM {NARROW}) GROUP").replace("LEFT JOIN f_meta_column c", f"LEFT JOIN (SELECT * FROM {NARROW}) c")


NAMED = _narrow(NAMED)


@query("lin_output_positional", NAMED + "SELECT stmt_id, pos, to_table, to_name, out_name FROM named", ("f_col_lines", "f_meta_column"))
def lin_output_positional(spark, d):
    return named_lines(spark, d).select("stmt_id", "pos", "to_table", "to_name", "out_name")


@query("lin_tmp_target", """
SELECT stmt_id, CASE WHEN target = 'TOK_TMP_FILE' THEN created ELSE target END AS to_table FROM (
  SELECT c_custkey AS stmt_id, CASE WHEN c_custkey % 3 = 0 THEN 'TOK_TMP_FILE' ELSE concat('dw.cust_', CAST(floor(c_custkey / 8) AS BIGINT)) END AS target,
         concat('app.copy_', c_custkey % 5) AS created FROM customer)
""")
def lin_tmp_target(spark, d):
    """A created table's select has no named target; it takes the created name."""
    stmts = stmts_of(spark, d).withColumn("created", F.concat(F.lit("create table app.copy_"), F.col("stmt_id") % 5, F.lit(" as "), "stmt"))
    rows = stmts.select("stmt_id", F.when(F.col("stmt_id") % 3 == 0, "TOK_TMP_FILE").otherwise(F.col("target")).alias("target"),
                        F.get(T.output_names("created"), F.lit(0)).alias("created_table"))
    return rows.select("stmt_id", F.when(F.col("target") == "TOK_TMP_FILE", F.col("created_table")).otherwise(F.col("target")).alias("to_table"))


def job_column_edges(spark, d):
    return C.column_edges(named_lines(spark, d), "stmt_id", "conditions")


@query("lin_column_edges", NAMED + "SELECT DISTINCT src, dst FROM col_edges", ("f_col_lines", "f_meta_column"))
def lin_column_edges(spark, d):
    return job_column_edges(spark, d).select("src", "dst").distinct()


@query("lin_relation_rows", NAMED + """
SELECT e.stmt_id, o.column_id AS column_id, o.table_id AS table_id, i.table_id AS from_table_id,
       i.column_id AS from_column_id, replace(array_to_string(e.conditions, ', '), '''', '~') AS condition
FROM col_edges e
LEFT JOIN f_meta_column i ON concat(i.database_name, '.', i.table_name, '.', i.column_name) = e.src
LEFT JOIN f_meta_column o ON concat(o.database_name, '.', o.table_name, '.', o.column_name) = e.dst
""", ("f_col_lines", "f_meta_column"))
def lin_relation_rows(spark, d):
    rows = C.relation_rows(job_column_edges(spark, d), fixture(spark, d, "f_meta_column"))
    return rows.select("stmt_id", "column_id", "table_id", "from_table_id", "from_column_id",
                       F.translate(F.array_join("conditions", ", "), "'", "~").alias("condition"))


ENDS = NAMED + """,
ends AS (SELECT DISTINCT stmt_id, unnest([src, dst]) AS name FROM col_edges)
"""


def edge_ends(spark, d):
    """(stmt_id, name) of every source and output column of the statements."""
    return job_column_edges(spark, d).select("stmt_id", F.explode(F.array("src", "dst")).alias("name")).distinct()


@query("lin_problem_jobs", ENDS + """
SELECT e.stmt_id AS job_id, CASE WHEN t.table_id IS NULL THEN 'table' ELSE 'column' END AS problem, count(*) AS n
FROM ends e LEFT JOIN f_meta_column_old c ON concat(c.database_name, '.', c.table_name, '.', c.column_name) = lower(e.name)
LEFT JOIN (SELECT DISTINCT table_id, database_name, table_name FROM f_meta_column_old) t ON concat(t.database_name, '.', t.table_name) = lower(regexp_extract(e.name, '^(.*)\\.[^.]*$', 1))
WHERE c.column_id IS NULL GROUP BY ALL
""", ("f_col_lines", "f_meta_column", "f_meta_column_old"))
def lin_problem_jobs(spark, d):
    """Jobs with an end that metadata does not know: the table, or only its column."""
    old = fixture(spark, d, "f_meta_column_old")
    return M.unknown_ends(edge_ends(spark, d), old).groupBy(F.col("stmt_id").alias("job_id"), "problem").agg(F.count(F.lit(1)).alias("n"))


TRACED = """
SELECT p_partkey AS job_id, CAST(n AS INT) AS stmt_no, to_table, CAST(pos AS INT) AS pos, to_name, source FROM (
  SELECT p_partkey, 2 AS n, concat('dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT)) AS to_table, 0 AS pos, 'k' AS to_name, concat('ods.src_', CAST(floor(p_partkey / 4) AS BIGINT), '.k') AS source FROM part
  UNION ALL SELECT p_partkey, 2, concat('dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT)), 1, 'v', concat('db_', p_size % 6, '.dim_', p_size % 10, '.v') FROM part
  UNION ALL SELECT p_partkey, 3, concat('db_', p_size % 6, '.rpt_', CAST(floor(p_partkey / 9) AS BIGINT)), pos, c, concat(t, '.', c)
  FROM part, (SELECT 0 AS pos, 'k' AS c UNION ALL SELECT 1, 'v') cs, LATERAL (SELECT concat('dw.dst_', CAST(floor(p_partkey / 7) AS BIGINT)) AS t UNION ALL SELECT concat('ods.src_', CAST(floor((p_partkey + 17) / 4) AS BIGINT))) ts)
WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0
"""


@query("lin_column_trace", TRACED)
def lin_column_trace(spark, d):
    """Column lineage of the scheduled jobs from their texts: scopes, aliases, bare columns, WITH queries, unions."""
    lines = S.trace_lines(due_refs(spark, d), fixture(spark, d, "f_meta_column"))
    return lines.select("job_id", "stmt_no", "to_table", "pos", "to_name", F.explode("sources").alias("source"))


# What each spelling of f_shapes truly reads into which column; the table is ods.a_.. where nothing else is said.
SHAPE_LINES = """
SELECT c_custkey AS job_id, concat('dw.', t, '_', c_custkey) AS to_table, CAST(pos AS INT) AS pos, to_name,
       CASE src WHEN '' THEN '' WHEN 'own' THEN concat('default.t', c_custkey, '.k') WHEN 'both' THEN concat('ods.a_', c_custkey, '.k;ods.b_', c_custkey, '.k')
       ELSE concat('ods.', substr(src, 1, 1), '_', c_custkey, substr(src, 2)) END AS sources
FROM customer JOIN (VALUES
  (0, 'd', 0, 'k', 'a.k'), (0, 'd', 1, 'v', 'b.v'), (1, 'd', 0, 'k', 'a.k'), (2, 'd', 0, 'k', 'a.k'), (3, 'd', 0, 'k', 'a.k'), (4, 'd', 0, 'y', 'a.ts'), (4, 'd', 1, '', 'a.n'),
  (5, 'd', 0, 'k', 'a.k'), (6, 'd', 0, 'c', ''), (6, 'd', 1, 'e', ''), (7, 'd', 0, 'k', 'a.k'), (7, 'd', 1, 'k', 'b.k'), (8, 'd', 0, 'k', 'own'), (9, 'd', 0, 'p', 'a.v'),
  (10, 'd', 0, 'k', 'a.k'), (10, 'e', 0, 'v', 'a.v'), (11, 'd', 0, 's', 'a.v'), (12, 'd', 0, 'k', 'a.k'), (13, 'd', 0, 'k', 'a.k'), (13, 'd', 1, '', ''),
  (14, 'd', 0, 'k', 'both'), (15, 'd', 0, 'k', 'a.k')) l(shape, t, pos, to_name, src) ON c_custkey % 16 = shape
"""


@query("lin_subquery_trace", SHAPE_LINES)
def lin_subquery_trace(spark, d):
    """Column lines of every spelling of statements from its text, against the columns it was made from."""
    customers = fixture(spark, d, "f_shapes").select(F.col("id"))
    known = customers.select(F.lit("ods").alias("database_name"), F.concat(F.lit("a_"), "id").alias("table_name"), F.posexplode(F.array(*map(F.lit, ("k", "v", "ts", "n")))).alias("ordinal", "column_name"))
    lines = S.trace_lines(shape_refs(spark, d), known)
    return lines.select("job_id", "to_table", "pos", "to_name", F.array_join("sources", ";").alias("sources"))


@query("lin_script_relations", f"""
SELECT t.job_id, t.stmt_no, t.source AS src, concat(t.to_table, '.', t.to_name) AS dst, i.column_id AS from_column_id, i.table_id AS from_table_id, o.column_id, o.table_id,
       CASE t.stmt_no WHEN 2 THEN concat('LEFTOUTERJOIN:ods.src_', CAST(floor(p_partkey / 4) AS BIGINT), '.k = db_', p_size % 6, '.dim_', p_size % 10, '.k, WHERE:db_', p_size % 6, '.dim_', p_size % 10,
              '.v > $', '{{{{limit}}}} and db_', p_size % 6, '.dim_', p_size % 10, '.env = ~$', '{{{{env}}}}~ and db_', p_size % 6, '.dim_', p_size % 10, '.pt = ~$', '{{{{yesterday}}}}~') ELSE '' END AS condition
FROM ({TRACED}) t JOIN part ON p_partkey = t.job_id
LEFT JOIN f_meta_column i ON concat(i.database_name, '.', i.table_name, '.', i.column_name) = t.source
LEFT JOIN f_meta_column o ON concat(o.database_name, '.', o.table_name, '.', o.column_name) = concat(t.to_table, '.', t.to_name)
""".replace("{{", "{").replace("}}", "}"), ("f_meta_column",))
def lin_script_relations(spark, d):
    """Relation rows of the scheduled jobs from their texts, when a hundredth of the scripts has changed since the lines were made."""
    meta, store = fixture(spark, d, "f_meta_column"), scratch_path(spark, "relations")
    jobs = P.scheduled_jobs(jobs_of(spark, d))
    R.refresh(jobs.withColumn("script", F.when(F.col("id") % 100 == 1, F.replace("script", F.lit("nvl(b.v,0)"), F.lit("b.k"))).otherwise(F.col("script"))), meta, store)
    return R.relations(R.refresh(jobs, meta, store), meta).select("job_id", "stmt_no", "src", "dst", "from_column_id", "from_table_id", "column_id", "table_id", "condition")
