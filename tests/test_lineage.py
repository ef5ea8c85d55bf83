"""Hand-made scripts: one case per shape of statement."""
import pytest
from pyspark.sql import functions as F

from tracewell.operators import columns as C
from tracewell.operators import metadata as M
from tracewell.operators import scripts as S
from tracewell.operators import statements as T


def refs(spark, script):
    jobs = spark.createDataFrame([(1, script)], "id long, script string")
    rows = T.table_refs(jobs).orderBy("stmt_no").collect()
    return [(sorted(r["inputs"]), sorted(r["outputs"])) for r in rows if r["inputs"] or r["outputs"]]


def items(spark, stmt):
    df = spark.createDataFrame([(1, stmt)], "stmt_id long, stmt string")
    rows = C.select_items(C.scopes(df, "stmt_id"), "stmt_id").withColumn("refs", C.column_refs()).orderBy("scope", "branch", "pos").collect()
    return [(r["scope"], r["branch"], r["expr"], r["name"], r["refs"]) for r in rows]


def test_two_created_tables_in_the_default_database(spark):
    script = "create table t1 as select a from s1;\ncreate table if not exists t2 as select b as a2 from s2"
    assert refs(spark, script) == [(["default.s1"], ["default.t1"]), (["default.s2"], ["default.t2"])]


def test_use_set_add_and_comments(spark):
    script = "set x=1;\n use app ;\n  -- insert into table gone select * from nowhere\nadd jar y.jar;\ninsert overwrite table dest select * from a join dw.b on a.k = b.k;\nuse other;\ninsert into table t select 1 from u"
    assert refs(spark, script) == [(["app.a", "dw.b"], ["app.dest"]), (["other.u"], ["other.t"])]


def test_an_escaped_semicolon_does_not_cut(spark):
    script = r"insert into table t select split(x, '\;') from s; insert into table t2 select 1 from s2"
    assert refs(spark, script) == [(["default.s"], ["default.t"]), (["default.s2"], ["default.t2"])]


def test_with_names_are_no_inputs(spark):
    script = "with a as (select k from s1), b as (select k from s2) insert into table t select * from a join b on a.k = b.k"
    assert refs(spark, script) == [(["default.s1", "default.s2"], ["default.t"])]


def test_windows_line_ends_and_tabs(spark):
    assert refs(spark, "\t-- from x\r\ninsert into table\tt\r\nselect a\r\nfrom\ts") == [(["default.s"], ["default.t"])]


def test_qualified_lists(spark):
    df = spark.createDataFrame([("a.t&u",), ("x",), ("a.b.c",)], "n string")
    assert [r[0] for r in df.select(T.qualify(F.col("n"), F.lit("db"))).collect()] == ["a.t&db.u", "db.x", None]


def test_status_of_unreadable_statements(spark):
    jobs = spark.createDataFrame([(1, "use d; analyze x; select 1 from t; insert into table t values (1); insert into table t select 1 from s")], "id long, script string")
    assert [r["status"] for r in T.with_status(T.table_refs(jobs)).orderBy("stmt_no").collect()] == ["database", "no table", "no output table", "no input table", "ok"]


def test_items_constants_map_array_and_functions(spark):
    got = items(spark, "insert overwrite table dest select 1 + 1 as num, params['a,b'] as m, arr[0] item, concat(year, '-', month) as d, t.* from dw.test t")
    assert got == [
        ("", 0, "1 + 1", "num", []), ("", 0, "params['a,b']", "m", ["params"]), ("", 0, "arr[0]", "item", ["arr"]),
        ("", 0, "concat(year, '-', month)", "d", ["year", "month"]), ("", 0, "t.*", "", ["t.*"])]


def test_case_and_nested_calls(spark):
    got = items(spark, "select count(distinct case when a.x = 'y' then a.id else nvl(b.id, c.id) end) as n, cast(a.v as double) v from a join b on a.k=b.k")
    assert got[0][3:] == ("n", ["a.x", "a.id", "b.id", "c.id"])
    assert got[1][2:] == ("cast(a.v as double)", "v", ["a.v"])


@pytest.mark.parametrize("expr, columns", [
    ("cast(t.v as string)", ["t.v"]), ("cast(k as decimal(10, 2)) + 1e5", ["k"]), ("date '2020-01-01'", []), ("\"lit\"", []),
    ("sum(v) over (partition by g order by d rows between unbounded preceding and current row)", ["v", "g", "d"]),
    ("'it\\'s' || a.b", ["a.b"]), ("extract(year from ts)", ["ts"]), ("`t`.`c`", ["t.c"]), ("a1 + 2.5e-3", ["a1"]), ("interval 3 day + x", ["x"])])
def test_words_that_are_no_columns(spark, expr, columns):
    assert spark.createDataFrame([(expr,)], "expr string").select(C.column_refs()).first()[0] == columns


def test_spellings_of_tables(spark):
    assert refs(spark, "insert into dw.a select x.k from ods.t1 x, ods.t2 y where x.k = y.k order by k, v") == [(["ods.t1", "ods.t2"], ["dw.a"])]
    assert refs(spark, "create external table dw.a as select extract(year from ts) from `ods`.`t1` -- from ods.no\n/* from ods.no */") == [(["ods.t1"], ["dw.a"])]
    assert refs(spark, "insert into table dw.a select 'copied from here', \"join b\" from t1; insert into dw.b select split(v, ';') from t2") == [
        (["default.t1"], ["dw.a"]), (["default.t2"], ["dw.b"])]
    assert refs(spark, "with t1 as (select k from t1),b as (select k from T1) insert into dw.a select * from B join c on 1 = 1") == [(["default.c", "default.t1"], ["dw.a"])]
    assert refs(spark, "insert overwrite directory '/x' select a from t") == [(["default.t"], [])]


def test_a_with_query_named_like_its_table_stops_no_job(spark):
    jobs = spark.createDataFrame([(1, "with t1 as (select k from t1) insert into dw.a select k from t1"), (2, "insert into dw.b select q.k from s q")], "id long, script string")
    meta = spark.createDataFrame([("default", "t1", "k", 1, 1, 1)], "database_name string, table_name string, column_name string, table_id int, column_id long, ordinal int")
    lines = C.trace_columns(T.table_refs(jobs), meta).collect()
    assert (2, "dw.b", "k", "default.s.k") in {(r.job_id, r.to_table, r.to_name, r.source) for r in lines}


def test_shell_assignments_and_whole_names(spark):
    content = "a=\"ods.x\"\nb='ods.y'; c=`date`\nd=plain\nhive -e \"select \\\"q\\\" from $a join $b2 on ${b} = $d\"\nsh run.sh\n"
    scripts = spark.createDataFrame([(1, "/jobs/s.sh", content)], "script_id long, path string, content string")
    row = S.fill_shell_variables(S.hive_commands(scripts)).first()
    assert row.filled_sql == 'select "q" from ods.x join $b2 on ods.y = plain'
    assert row.missing == ["$b2"]
    files = spark.createDataFrame([("/jobs/run.sh", "inner\n")], "path string, content string")
    assert S.inline_sources(scripts, files).first().content.startswith("inner\n")


def test_union_branches_and_with_queries_are_scopes(spark):
    got = items(spark, "with q as (select k, sum(v) as s from src group by k) insert into table t select q.k from q union all select k2 from other")
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [("", 0, "q.k", "k"), ("", 1, "k2", "k2"), ("q", 0, "k", "k"), ("q", 0, "sum(v)", "s")]


def test_sources_and_aliases(spark):
    df = spark.createDataFrame([(1, "select 1 from app.users u left outer join log as l on u.id = l.id join other where u.x = 1")], "stmt_id long, stmt string")
    rows = C.scope_sources(C.scopes(df, "stmt_id"), "stmt_id").orderBy("place").collect()
    assert [(r["source"], r["alias"]) for r in rows] == [("app.users", "u"), ("log", "l"), ("other", "other")]


def test_conditions_of_where_and_joins(spark):
    df = spark.createDataFrame([("select a from t x left outer join u y on x.k = y.k and y.z in (1, 2) join w on w.k = x.k where x.a <> 'q' and y.b > 1 group by a",)], "text string")
    assert df.select(C.conditions()).first()[0] == ["LEFTOUTERJOIN:x.k = y.k and y.z in (1, 2)", "JOIN:w.k = x.k", "WHERE:x.a <> 'q' and y.b > 1"]


def test_join_kinds(spark):
    df = spark.createDataFrame([("a LEFT  JOIN b full outer join c left semi join d cross join e join f",), ("/*+ MAPJOIN(b) */ a join b",)], "stmt string")
    assert [r[0] for r in df.select(T.join_kinds()).collect()] == [["LEFTOUTERJOIN", "FULLOUTERJOIN", "LEFTSEMIJOIN", "CROSSJOIN", "JOIN"], ["MAPJOIN"]]


def test_union_merge_takes_the_first_usable_name(spark):
    lines = spark.createDataFrame(
        [(1, 0, 1, "", "0", "0", "d.t", "WHERE:x"), (1, 1, 1, "id", "s.a.id", "s.a.id", "d.t", "WHERE:y"), (1, 2, 1, "pid", "s.b.pid", "s.b.pid", "d.t", "WHERE:x")],
        "stmt_id int, branch int, pos int, to_name string, expr string, from_names string, to_table string, cond string")
    row = C.merge_union_branches(lines).first()
    assert (row["to_name"], row["expr"], row["from_names"], row["conditions"]) == ("id", "0&s.a.id&s.b.pid", ["0", "s.a.id", "s.b.pid"], ["WHERE:x", "WHERE:y"])


def test_nested_scopes_collapse_to_base_sources(spark):
    rows = [(1, 1, "c", 2, None, "WHERE:o"), (1, 2, "c", 3, None, None), (1, 2, "c", None, "d.x.c", "JOIN:j"), (1, 3, "c", None, "d.y.c", "WHERE:i")]
    df = spark.createDataFrame(rows, "stmt_id int, scope_id int, column_name string, child_scope_id int, source string, cond string")
    got = {(r["source"], tuple(r["conds"])) for r in C.collapse_scopes(df).collect()}
    assert got == {("d.x.c", ("JOIN:j", "WHERE:o")), ("d.y.c", ("WHERE:i", "WHERE:o"))}


def test_settings_are_inherited_and_filled_literally(spark):
    groups = spark.createDataFrame([(1, 0, '{"a":"g1","b":"g1"}', 1), (2, 1, '{"b":"g2"}', 1), (3, 2, "no json", 1), (9, 3, '{"a":"x"}', 0)], "id int, parent int, configs string, existed int")
    jobs = spark.createDataFrame([(7, 3, '{"c":"$1.*"}', "${a} ${b} ${c} ${d}"), (8, 9, None, "${a}")], "id long, group_id int, configs string, script string")
    out = S.effective_settings(jobs, groups).select("id", S.substitute().alias("s")).orderBy("id").collect()
    assert [r["s"] for r in out] == ["g1 g2 $1.* ${d}", "${a}"]


def test_a_cycle_of_groups_ends(spark):
    groups = spark.createDataFrame([(1, 2, "{}", 1), (2, 1, "{}", 1)], "id int, parent int, configs string, existed int")
    assert S.group_chain(groups).count() == 4


def test_dates(spark):
    df = spark.createDataFrame([('${zdt.addDay(-1).format("yyyyMMdd")} ${zdt.addDay(2).format("yyyy-MM-dd HH:mm:ss")} ${yesterday} ${x}', "2024-03-01 04:05:06")], "script string, at string")
    got = df.withColumn("at", F.col("at").cast("timestamp_ntz")).select(S.render_dates("script", "at")).first()[0]
    assert got == "20240229 2024-03-03 04:05:06 20240229 ${x}"


def test_shell_scripts(spark):
    text = 'tbl="a.b"\ntbl2="$tbl where c"\nhive -e "insert into table t select * from ${tbl2} and $gone"\n  $exe_hive2 -S -e "$tbl"\n'
    df = spark.createDataFrame([(1, "/j/x.sh", text)], "script_id long, path string, content string")
    rows = S.fill_shell_variables(S.hive_commands(df)).orderBy("call_no").collect()
    assert [(r["filled_sql"], r["missing"]) for r in rows] == [("insert into table t select * from a.b where c and $gone", ["$gone"]), ("a.b", [])]


def test_python_scripts(spark):
    text = 't = "a.b"\nq = """insert into table x\nselect * from %(t)s"""\nr = """select 1"""\nrunHiveCmd(q, 1)\nrunHiveCmd(r)\n'
    df = spark.createDataFrame([(1, "/j/x.py", text)], "script_id long, path string, content string")
    rows = S.python_commands(df).collect()
    assert [(r["variable"], r["sql_text"]) for r in rows] == [("q", "insert into table x\nselect * from a.b")]


def test_sourced_files_are_put_in_front(spark):
    scripts = spark.createDataFrame([(1, "/j/a.sh", "source b.sh\nsource x/c.sh\nrun"), (2, "/j/d.sh", "run")], "script_id long, path string, content string")
    files = spark.createDataFrame([("/j/b.sh", "B\n"), ("/k/c.sh", "C\n")], "path string, content string")
    rows = S.inline_sources(scripts, files).orderBy("script_id").collect()
    assert [(r["content"], r["n_missing"]) for r in rows] == [("B\nsource b.sh\nsource x/c.sh\nrun", 1), ("run", 0)]


def test_snapshot_diff(spark):
    schema = "database_name string, table_name string, column_name string, data_type string"
    old = spark.createDataFrame([("d", "t", "a", "int"), ("d", "t", "b", "int"), ("d", "t", "c", None)], schema)
    new = spark.createDataFrame([("d", "t", "a", "int"), ("d", "t", "b", "long"), ("d", "t", "e", "int")], schema)
    got = {(r["column_name"], r["change"]) for r in M.snapshot_diff(old, new).collect()}
    assert {("b", "retyped"), ("e", "added")} <= got


@pytest.mark.parametrize("text,want", [("a, b", ["a", "b"]), ("f(a, g(b, c)), 'x,y'", ["f(a, g(b, c))", "'x,y'"]), ("concat('(', a), b", ["concat('(', a)", "b"])])
def test_split_items(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.split_items(F.col("t"))).first()[0] == want


def test_metadata_grows_with_the_data(spark):
    """No derived input is cut to a prefix of its tables."""
    from tracewell.sources import fixture

    small, large = (fixture(spark, f"/root/testdata/{d}", "f_meta_table") for d in ("sf0.001", "sf0.01"))
    assert large.count() > 6 * small.count()
    assert large.select("table_id").distinct().count() == large.count()
    for name in ("f_col_lines", "f_jobs"):
        assert fixture(spark, "/root/testdata/sf0.01", name).count() > 6 * fixture(spark, "/root/testdata/sf0.001", name).count()


def lines_of(spark, script, known=()):
    jobs = spark.createDataFrame([(1, script)], "id long, script string")
    meta = spark.createDataFrame([("default", "none", "none"), *known], "database_name string, table_name string, column_name string")
    return {(r.to_table, r.to_name, r.source) for r in C.trace_columns(T.table_refs(jobs), meta).collect()}


def test_columns_through_queries_in_from(spark):
    assert lines_of(spark, "insert into dw.a select q.s from (select t.v as s from ods.t1 t) q") == {("dw.a", "s", "ods.t1.v")}
    assert lines_of(spark, "insert into dw.a select o.x from (select i.y as x from (select max(t.z) as y from ods.t1 t) i) o join (select k from ods.t2) p on p.k = o.x") == {("dw.a", "x", "ods.t1.z")}
    assert lines_of(spark, "insert into dw.a select u.d from (select d from ods.l union all select e as d from ods.r) u join ods.b b on u.d = b.d") == {("dw.a", "d", "ods.l.d"), ("dw.a", "d", "ods.r.e")}
    assert lines_of(spark, "with w as (select q.c as n from (select c from ods.t) q) insert into dw.a select n from w") == {("dw.a", "n", "ods.t.c")}


def test_new_texts_are_dealt_before_they_are_traced(spark, monkeypatch):
    from tracewell.operators import relations
    from tracewell.storage import scratch_path
    dealt = []
    real = relations.use_all_cores
    monkeypatch.setattr(relations, "use_all_cores", lambda df: dealt.append(df.count()) or real(df))
    jobs = spark.createDataFrame([(1, "insert into dw.d select k from ods.a"), (2, "insert into dw.d select k from ods.a"), (3, "insert into dw.e select v from ods.b")], "id long, script string")
    meta = spark.createDataFrame([], "database_name string, table_name string, column_name string, table_id int, column_id int")
    store = scratch_path(spark, "relations")
    for _ in range(2):
        assert sorted((r.job_id, r.sources) for r in relations.refresh(jobs, meta, store).collect()) == [(1, ["ods.a.k"]), (2, ["ods.a.k"]), (3, ["ods.b.v"])]
    assert dealt == [2]
