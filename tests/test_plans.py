"""What the physical plans must and must not contain, and a few known values."""
import hashlib
import io
import zlib
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tracewell.operators.joins import broadcast_if_small, not_in
import __spark_entry__  # noqa: F401  fills the registry
from tracewell.registry import QUERIES
from tracewell.sources import table
from tracewell.storage import shared_dir


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("key", ["lin_table_edges", "join_inner", "join_theta", "join_range", "join_interval", "sub_not_in", "win_agg_range", "gr_degree"])
def test_no_product_or_nested_loop(key, spark, sf_dir):
    text = plan(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in text
    if key != "sub_not_in":  # there it is a single counted row
        assert "BroadcastNestedLoopJoin" not in text


def test_metadata_lookups_are_equi_joins(spark, sf_dir):
    """The operators alone: the made-up metadata itself is a small product."""
    from tracewell.operators import columns as C, metadata as M
    from tracewell.sources import fixture
    from tracewell.storage import cut
    meta = cut(fixture(spark, sf_dir, "f_meta_column"))
    edges = spark.range(1000).selectExpr("id AS stmt_id", "concat('ods.src_', id % 50, '.k') AS src", "concat('dw.dst_', id % 40, '.k') AS dst", "'WHERE' AS conditions")
    for df in (C.relation_rows(edges, meta), M.unknown_ends(edges.withColumnRenamed("src", "name"), meta), M.used_tables(edges.withColumnRenamed("src", "name"), meta)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_lookups_that_grow_are_no_broadcast(spark, sf_dir):
    """Their sizes are estimated from compressed files, far too low; these are small enough to be broadcast by estimate."""
    from tracewell.operators import graph as G, metadata as M
    from tracewell.operators.skew import lookup_join
    refs = spark.range(9).selectExpr("id AS stmt_id", "1 AS stmt_no", "array(concat('ods.t_', id)) AS inputs", "array('dw.d') AS outputs")
    lines = spark.range(9).selectExpr("id AS stmt_id", "0 AS pos", "'k' AS to_name", "'dw.d' AS to_table", "concat('ods.t_', id, '.k') AS from_names")
    meta = spark.range(9).selectExpr("'ods' AS database_name", "concat('t_', id) AS table_name", "'k' AS column_name", "id AS table_id", "id AS column_id")
    edges = spark.range(9).selectExpr("concat('ods.t_', id) AS src", "'dw.d' AS dst")
    for df in (M.report(refs, lines, meta, meta), M.unknown_tables(refs, meta), G.exists_flag(edges, edges, ["src", "dst"]), G.exists_flag(G.nodes(edges), G.nodes(edges), ["name"])):
        assert "Broadcast" not in plan(df)
    assert "BroadcastHashJoin" in plan(lookup_join(edges, edges, ["src"], small=True))


def test_column_lines_are_joined_without_broadcasts(spark, sf_dir):
    from tracewell.operators import scopes as S, statements as T
    jobs = spark.createDataFrame([(i, f"insert into dw.d_{i} select q.k, b.v from (select k from ods.a_{i} where v > 1) q join ods.b b on q.k = b.k") for i in range(9)], "id long, script string")
    meta = spark.createDataFrame([("ods", "b", "k", 1, 1)], "database_name string, table_name string, column_name string, table_id int, column_id int")
    lines = S.trace_lines(T.table_refs(jobs), meta)
    assert "Broadcast" not in plan(lines)
    assert sorted((r.job_id, r.to_name, r.sources) for r in lines.collect())[:2] == [(0, "k", ["ods.a_0.k"]), (0, "v", ["ods.b.v"])]


def test_heavy_rows_are_dealt_by_their_number(spark):
    """A file of many rows is dealt over more tasks than there are cores."""
    from tracewell.sources import use_all_cores
    rows = spark.range(1000).coalesce(1)
    for task_rows, tasks in ((1000, spark.sparkContext.defaultParallelism), (10, 100)):
        dealt = use_all_cores(rows, task_rows)
        assert dealt.rdd.getNumPartitions() == tasks and dealt.count() == 1000
        assert max(dealt.rdd.glom().map(len).collect()) <= 2 * 1000 // tasks


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["flt_compare"](spark, sf_dir))
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "o_orderpriority" not in text.split("ReadSchema")[1]


def test_script_work_needs_no_shuffle_on_many_files(spark, sf_dir):
    from tracewell.operators import statements as T
    jobs = spark.createDataFrame([(i, "use a; insert into table t select 1 from s") for i in range(64)], "id long, script string")
    assert "Exchange" not in plan(T.table_refs(jobs))


def test_top_rows_are_limited_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["win_topk_group"](spark, sf_dir))
    assert text.count("WindowGroupLimit") >= 2


def test_aggregates_are_partial(spark, sf_dir):
    assert "partial_count" in plan(QUERIES["agg_basic"](spark, sf_dir))


def test_a_broadcast_is_hinted_below_the_limit_only(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey")
    big = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_suppkey"))
    hinted = lambda limit: "hint" in lines.join(broadcast_if_small(big, limit), "l_suppkey")._jdf.queryExecution().logical().toString().lower()
    assert hinted(10_000_000) and not hinted(10)


def test_not_in_rules(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    found = lambda df: sorted((r["k"] for r in df.collect()), key=repr)
    assert found(not_in(rows, "k", values(1))) == [2]
    assert found(not_in(rows, "k", values(1, None))) == []
    assert found(not_in(rows, "k", values())) == [1, 2, None]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured.rstrip("/")


def test_checksums_and_codes(spark):
    df = spark.createDataFrame([("Robert", "Rupert")], "a string, b string")
    row = df.select(F.crc32(F.encode("a", "utf-8")).alias("c"), F.soundex("a").alias("x"), F.soundex("b").alias("y"), F.hash(F.lit("Spark")).alias("h")).first()
    assert row["c"] == zlib.crc32(b"Robert") and row["x"] == row["y"] == "R163"


def test_assertions_stop_the_job(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(3).select(F.assert_true(F.col("id") < 2, "out of range")).collect()


def test_lenient_forms(spark):
    row = spark.range(1).selectExpr(
        "try_divide(1, 0) AS a", "try_cast('x' AS int) AS b", "get(array(1), 5) AS c", "coalesce(size(CAST(NULL AS array<int>)), -1) AS d").first()
    assert tuple(row) == (None, None, None, -1)


def test_whole_numbers_beyond_doubles(spark):
    from tracewell.operators.profiling import column_stats
    df = spark.createDataFrame([(9007199254740993, 1.5, "a"), (-9007199254740993, None, None), (None, 2.5, "b")], "n long, x double, t string")
    found = {r.column_name: r for r in column_stats(df).collect()}
    assert (found["n"].min_integer, found["n"].max_integer) == (-9007199254740993, 9007199254740993)
    assert found["x"].max_integer is None and found["x"].max_number == 2.5
    assert found["t"].max_integer is None and (found["t"].min_text, found["t"].n_nulls) == ("a", 1)


def test_count_min_estimates(spark):
    """A sketch wide enough gives true counts; a narrow one none below them; nulls and numbers that were never counted."""
    from tracewell.operators.aggregates import count_min_estimate
    rows = spark.range(2000).selectExpr("case when id % 3 = 0 then 7L else (id % 50) - 25 end as k")
    true = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    for error in (0.0005, 0.2):
        sketch = rows.agg(F.hex(F.count_min_sketch("k", F.lit(error), F.lit(0.95), F.lit(1))).alias("sketch"))
        asked = spark.createDataFrame([(k,) for k in [*true, 4_000_000_000, None]], "k long")
        got = {r.k: r.n for r in asked.crossJoin(sketch).select("k", count_min_estimate(F.col("sketch"), F.col("k")).alias("n")).collect()}
        assert got[None] is None and got[4_000_000_000] >= 0
        assert all(got[k] >= n for k, n in true.items())
        if error < 0.01:
            assert {k: got[k] for k in true} == true


def test_merged_summaries_equal_the_truth_within_the_error(spark):
    from tracewell.operators.profiling import merged, summaries
    rows = spark.range(20000).selectExpr("id % 30 as day", "id % 2 as k", "case when id % 10 = 0 then null else id * 7919 % 20000 end as v", "id % 777 as e")
    whole = {r.k: r for r in merged(summaries(rows, ["day", "k"], "v", "e"), [F.col("k")]).select(
        "k", F.kll_sketch_get_n_double("quantiles").alias("n"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("median"), F.hll_sketch_estimate("distinct").alias("e")).collect()}
    for r in rows.groupBy("k").agg(F.count("v").alias("n"), F.count_distinct("e").alias("e")).collect():
        got = whole[r.k]
        below = rows.filter((F.col("k") == r.k) & (F.col("v") <= got.median)).count()
        assert got.n == r.n and abs(below - r.n / 2) <= 0.02 * r.n and abs(got.e - r.e) <= 0.05 * r.e
    assert merged(summaries(rows.limit(0), ["day", "k"], "v", "e"), [F.col("k")]).count() == 0


def test_tables_bucketed_alike_join_without_a_shuffle(spark, sf_dir):
    from tracewell.plans.ordering import bucketed, order_totals
    before = {t.name for t in spark.catalog.listTables()}
    QUERIES["prt_bucketed_join"](spark, sf_dir)
    assert {t.name for t in spark.catalog.listTables()} == before
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "orders_by_key")
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", "lines_by_key")
    text = plan(order_totals(spark, orders, lines))
    assert "SortMergeJoin" in text and "Exchange" not in text
    for name in (orders, lines):
        spark.sql(f"DROP TABLE {name}")


def test_xpath_rows_are_dealt_in_small_tasks(spark, tmp_path):
    """Every path parses its row's XML anew, so a task gets a bounded number of rows however large the table."""
    rows = spark.range(60_000).selectExpr("id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    sizes = QUERIES["fn_xpath"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 60_000
    assert max(r["count"] for r in sizes) <= 2_600


def test_page_files_are_listed_folder_by_folder(spark, tmp_path, monkeypatch):
    """The driver never lists the files of all pages at once; a page is a file, also where an id comes twice or is missing."""
    import tracewell.plans.sources_sinks as sinks

    rows = [(i, f"<p>page {i}\n</p>") for i in range(35)] + [(7, "again"), (None, "no id"), (40, None)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    listed, real = [], sinks.whole_files
    monkeypatch.setattr(sinks, "FOLDER_FILES", 10, raising=False)
    monkeypatch.setattr(sinks, "whole_files", lambda session, path: (out := real(session, path), listed.append(len(out.inputFiles())))[0])
    found = QUERIES["src_script_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((i, len(t or ""), hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    assert sum(listed) == len(rows) and max(listed) <= 10


def test_no_page_gives_no_file(spark, tmp_path):
    spark.createDataFrame([], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["src_script_files"](spark, str(tmp_path)).collect() == []
