"""Queries over the lineage graph."""
from pyspark.sql import functions as F

from tracewell.operators import columns as C
from tracewell.operators import graph as G
from tracewell.operators import metadata as M
from tracewell.operators import scripts as S
from tracewell.operators import statements as T
from tracewell.registry import query
from tracewell.sources import fixture, table
from tracewell.operators.windows import neighbours

from .column_lineage import ENDS, edge_ends, job_column_edges
from .table_lineage import STMTS, due_refs


def job_edges(spark, d):
    return G.table_name_edges(T.table_edges(due_refs(spark, d)))


def layered_edges(spark, d):
    return G.table_name_edges(fixture(spark, d, "f_table_edges"))


def event_flow(spark, d):
    """Event types that follow each other for a user: a graph with cycles."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    following = neighbours(events, ["user_id"], ["ts", "event_id"], {"nxt": ("event_type", 1)})
    return (following.filter("nxt is not null and nxt <> event_type")
            .select(F.concat(F.lit("app."), "event_type").alias("src"), F.concat(F.lit("app."), "nxt").alias("dst")).distinct())


JOB_EDGES = STMTS.rstrip() + ",\ne AS (SELECT concat(src_db, '.', src_table) AS src, concat(dst_db, '.', dst_table) AS dst FROM edges)\n"
LAYERED = "SELECT concat(src_db, '.', src_table) AS src, concat(dst_db, '.', dst_table) AS dst FROM f_table_edges"
FLOW = "SELECT concat(src_db, '.', src_table) AS src, concat(dst_db, '.', dst_table) AS dst FROM f_event_flow"


@query("gr_table_nodes", JOB_EDGES + "SELECT src AS name FROM e UNION SELECT dst FROM e", ("f_jobs",))
def gr_table_nodes(spark, d):
    return G.nodes(job_edges(spark, d))


@query("gr_column_nodes", ENDS + "SELECT DISTINCT name FROM ends", ("f_col_lines", "f_meta_column"))
def gr_column_nodes(spark, d):
    return G.nodes(job_column_edges(spark, d).select("src", "dst"))


@query("gr_table_edges", JOB_EDGES + "SELECT src, dst FROM e", ("f_jobs",))
def gr_table_edges(spark, d):
    return job_edges(spark, d)


@query("gr_column_edges", ENDS + "SELECT DISTINCT src, dst FROM col_edges", ("f_col_lines", "f_meta_column"))
def gr_column_edges(spark, d):
    return job_column_edges(spark, d).select("src", "dst").distinct()


@query("gr_node_exists", JOB_EDGES + """
SELECT p.name, CASE WHEN p.name IN (SELECT src FROM e UNION SELECT dst FROM e) THEN 1 ELSE 0 END AS found
FROM (SELECT concat(database_name, '.', table_name) AS name FROM f_meta_table) p
""", ("f_jobs", "f_meta_table"))
def gr_node_exists(spark, d):
    probes = fixture(spark, d, "f_meta_table").select(F.concat_ws(".", "database_name", "table_name").alias("name"))
    return G.exists_flag(probes, G.nodes(job_edges(spark, d)), ["name"])


@query("gr_edge_exists", JOB_EDGES + """
SELECT p.src, p.dst, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS found
FROM (SELECT DISTINCT regexp_extract(from_names, '^(.*)\\.[^.]*$', 1) AS src, to_table AS dst FROM f_col_lines WHERE contains(from_names, '.')) p
LEFT JOIN e ON e.src = p.src AND e.dst = p.dst
""", ("f_jobs", "f_col_lines"))
def gr_edge_exists(spark, d):
    probes = (fixture(spark, d, "f_col_lines").filter(F.contains("from_names", F.lit(".")))
              .select(F.regexp_extract("from_names", r"^(.*)\.[^.]*$", 1).alias("src"), F.col("to_table").alias("dst")).distinct())
    return G.exists_flag(probes, job_edges(spark, d), ["src", "dst"])


@query("gr_merge_nodes", JOB_EDGES + """
SELECT concat(database_name, '.', table_name) AS name, 'metadata' AS origin FROM f_meta_table
UNION ALL
SELECT name, 'script' FROM (SELECT src AS name FROM e UNION SELECT dst FROM e) n
WHERE name NOT IN (SELECT concat(database_name, '.', table_name) FROM f_meta_table)
""", ("f_jobs", "f_meta_table"))
def gr_merge_nodes(spark, d):
    old = fixture(spark, d, "f_meta_table").select(F.concat_ws(".", "database_name", "table_name").alias("name"), F.lit("metadata").alias("origin"))
    return G.merge_nodes(old, G.nodes(job_edges(spark, d)).withColumn("origin", F.lit("script")), "name")


@query("gr_has_column", JOB_EDGES + """
SELECT DISTINCT n.name AS table_name, concat(n.name, '.', c.column_name) AS column_name
FROM (SELECT src AS name FROM e UNION SELECT dst FROM e) n JOIN f_meta_column c ON concat(c.database_name, '.', c.table_name) = n.name
""", ("f_jobs", "f_meta_column"))
def gr_has_column(spark, d):
    columns = fixture(spark, d, "f_meta_column").select(F.concat_ws(".", "database_name", "table_name").alias("name"), "column_name")
    return (G.nodes(job_edges(spark, d)).join(columns, "name")
            .select(F.col("name").alias("table_name"), F.concat_ws(".", "name", "column_name").alias("column_name")).distinct())


PROPS = """
SELECT src, dst, string_agg(cond, ';' ORDER BY cond) AS props FROM (
  SELECT DISTINCT l.from_names AS src, concat(l.to_table, '.', l.to_name) AS dst, l.cond
  FROM f_col_lines l JOIN f_jobs j ON j.id = l.stmt_id WHERE j.run_type = '{kind}' AND l.to_name <> '') GROUP BY 1, 2
"""


@query("gr_merge_edges", f"""
WITH o AS ({PROPS.format(kind='hive')}), n AS ({PROPS.format(kind='spark')})
SELECT coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst, coalesce(n.props, o.props) AS props
FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst
""", ("f_col_lines", "f_jobs"))
def gr_merge_edges(spark, d):
    """Edges of the Hive jobs, merged with those of a later run of the Spark jobs."""
    def edges(kind):
        jobs = fixture(spark, d, "f_jobs").filter(F.col("run_type") == kind).select(F.col("id").alias("stmt_id"))
        lines = fixture(spark, d, "f_col_lines").filter("to_name <> ''").join(jobs, "stmt_id")
        named = lines.select(F.col("from_names").alias("src"), F.concat_ws(".", "to_table", "to_name").alias("dst"), "cond").distinct()
        return named.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_list("cond")), ";").alias("props"))
    return G.merge_edges(edges("hive"), edges("spark"))


def walks(edges, start, depth, forward=True):
    near, far = ("src", "dst") if forward else ("dst", "src")
    return f"""
WITH RECURSIVE e AS ({edges}),
walk(walk, last, used, depth) AS (
  SELECT concat({near}, ' -> ', {far}), {far}, [concat({near}, ' -> ', {far})], 1 FROM e WHERE {near} = '{start}'
  UNION ALL
  SELECT concat(w.walk, ' -> ', e.{far}), e.{far}, list_append(w.used, concat(e.{near}, ' -> ', e.{far})), w.depth + 1
  FROM walk w JOIN e ON e.{near} = w.last WHERE w.depth < {depth} AND NOT list_contains(w.used, concat(e.{near}, ' -> ', e.{far})))
"""


@query("gr_downstream", walks(LAYERED, "ods.ASIA", 3) + "SELECT walk AS path, depth FROM walk ORDER BY walk LIMIT 100", ("f_table_edges",))
def gr_downstream(spark, d):
    return G.search(layered_edges(spark, d), source="ods.ASIA", depth=3, limit=100)


@query("gr_upstream", walks(LAYERED, "dws.Brand#1", 3, False) + """
SELECT array_to_string(list_reverse(string_split(walk, ' -> ')), ' -> ') AS path, depth FROM (SELECT * FROM walk ORDER BY walk LIMIT 100)
""", ("f_table_edges",))
def gr_upstream(spark, d):
    return G.search(layered_edges(spark, d), target="dws.Brand#1", depth=3, limit=100)


@query("gr_between", walks(FLOW, "app.signup", 4) + "SELECT walk AS path, depth FROM walk WHERE last = 'app.purchase' ORDER BY walk LIMIT 50", ("f_event_flow",))
def gr_between(spark, d):
    return G.search(event_flow(spark, d), source="app.signup", target="app.purchase", depth=4, limit=50)


REACH = """
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({edges})),
walk(start, name, distance) AS (
  SELECT src, dst, 1 FROM e WHERE {starts}
  UNION
  SELECT w.start, e.dst, w.distance + 1 FROM walk w JOIN e ON e.src = w.name WHERE w.distance < 8)
"""
COLUMN_GRAPH = f"SELECT concat(src, '.k') AS src, concat(dst, '.k') AS dst FROM ({LAYERED}) UNION ALL SELECT concat(src, '.k'), concat(dst, '.k') FROM ({FLOW})"


@query("gr_column_impact", REACH.format(edges=COLUMN_GRAPH, starts="src LIKE 'ods.%' OR src = 'app.error.k'") + """
SELECT start, name, CAST(min(distance) AS INT) AS distance FROM walk WHERE name <> start GROUP BY 1, 2
""", ("f_table_edges", "f_event_flow"))
def gr_column_impact(spark, d):
    both = layered_edges(spark, d).unionByName(event_flow(spark, d))
    edges = both.select(F.concat("src", F.lit(".k")).alias("src"), F.concat("dst", F.lit(".k")).alias("dst"))
    starts = edges.filter(F.startswith("src", F.lit("ods.")) | (F.col("src") == "app.error.k")).select(F.col("src").alias("start"))
    return G.reachable(edges, starts)


@query("lin_dataset_reachable", REACH.format(edges=LAYERED, starts="src LIKE 'dim.%'") + """
SELECT s.s_suppkey AS probe_id, concat('dim.', n.n_name) AS src, concat('dws.Brand#', s.s_suppkey % 27 + 1) AS dst,
       EXISTS (SELECT 1 FROM walk w WHERE w.start = concat('dim.', n.n_name) AND w.name = concat('dws.Brand#', s.s_suppkey % 27 + 1)) AS is_ancestor
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
""", ("f_table_edges",))
def lin_dataset_reachable(spark, d):
    """Is one dataset an ancestor of another, for one pair of datasets per supplier."""
    probes = (table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
              .select(F.col("s_suppkey").alias("probe_id"), F.concat(F.lit("dim."), "n_name").alias("src"),
                      F.concat(F.lit("dws.Brand#"), F.col("s_suppkey") % 27 + 1).alias("dst")))
    return G.reaches(layered_edges(spark, d), probes).withColumnRenamed("found", "is_ancestor")


@query("gr_unused_tables", ENDS.rstrip() + """,
names AS MATERIALIZED (SELECT DISTINCT lower(name) AS key FROM ends),
olds AS MATERIALIZED (SELECT DISTINCT concat(database_name, '.', table_name, '.', column_name) AS key, table_id FROM f_meta_column_old),
used AS MATERIALIZED (SELECT DISTINCT olds.table_id FROM olds JOIN names ON names.key = olds.key)
SELECT concat(t.database_name, '.', t.table_name) AS name, t.table_id FROM f_meta_table t
WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.table_id = t.table_id)
""", ("f_col_lines", "f_meta_column", "f_meta_table", "f_meta_column_old"))
def gr_unused_tables(spark, d):
    used = M.used_tables(edge_ends(spark, d), fixture(spark, d, "f_meta_column_old"))
    tables = fixture(spark, d, "f_meta_table").select(F.concat_ws(".", "database_name", "table_name").alias("name"), "table_id")
    return tables.join(used, "table_id", "left_anti")


@query("gr_degree", JOB_EDGES + """,
i AS (SELECT dst AS name, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS name, count(*) AS n FROM e GROUP BY 1)
SELECT coalesce(i.name, o.name) AS name, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out,
       CASE WHEN i.n IS NULL THEN 'root' WHEN o.n IS NULL THEN 'leaf' ELSE 'inner' END AS kind
FROM i FULL JOIN o ON o.name = i.name
""", ("f_jobs",))
def gr_degree(spark, d):
    return G.degrees(job_edges(spark, d))
