"""Column lines from texts: the shapes of statements that the lineage must read, at any nesting."""
import pytest

from tracewell.operators import scopes as S
from tracewell.operators import statements as T

META = [("app", "hand_qq_passenger", "statid", 1), ("app", "hand_qq_passenger", "channel", 2), ("app", "return_benefit_base_foo", "id", 1), ("ods", "t1", "k", 1), ("ods", "t1", "v", 2)]
CASES = {
    "two created tables": ("create table target_table location '/data/location' as select a from source_table; create table target_table2 as select a2 from source_table2", [
        ("default.target_table", 0, "a", ["default.source_table.a"], []), ("default.target_table2", 0, "a2", ["default.source_table2.a2"], [])]),
    "stars in a joined query": ("use app; insert into table dest select statid from (select a.*,*,return_benefit_base_foo.* from hand_qq_passenger a join return_benefit_base_foo b on a.statid=b.id where a.channel > 10) base", [
        ("app.dest", 0, "statid", ["app.hand_qq_passenger.statid"], ["JOIN:app.hand_qq_passenger.statid = app.return_benefit_base_foo.id", "WHERE:app.hand_qq_passenger.channel > 10"])]),
    "filter": ("INSERT OVERWRITE table app.dest PARTITION (year='2015',day='$day') select ip,name from test where age > 10 and area in (11,22) or name<>'$V'", [
        ("app.dest", 0, "ip", ["default.test.ip"], ["WHERE:default.test.age > 10 and default.test.area in (11,22) or default.test.name <> '$V'"]),
        ("app.dest", 1, "name", ["default.test.name"], ["WHERE:default.test.age > 10 and default.test.area in (11,22) or default.test.name <> '$V'"])]),
    "join with functions": ("use app;insert into table dest select nvl(a.name,0) as name_al, b.ip from test a join test1 b on a.ip=b.ip where to_date(b.date) > date_sub('20151001',7)", [
        ("app.dest", 0, "name_al", ["app.test.name"], ["JOIN:app.test.ip = app.test1.ip", "WHERE:to_date(app.test1.date) > date_sub('20151001',7)"]),
        ("app.dest", 1, "ip", ["app.test1.ip"], ["JOIN:app.test.ip = app.test1.ip", "WHERE:to_date(app.test1.date) > date_sub('20151001',7)"])]),
    "constant, map, array, call": ("use dw;insert into table dest select 1+1 as num, params['cid'] as maptest,arr[0] as arrtest,CONCAT(year,month,day) as date from test", [
        ("dw.dest", 0, "num", [], []), ("dw.dest", 1, "maptest", ["dw.test.params"], []), ("dw.dest", 2, "arrtest", ["dw.test.arr"], []),
        ("dw.dest", 3, "date", ["dw.test.day", "dw.test.month", "dw.test.year"], [])]),
    "union in a query, joined": ("use app;SELECT u.id, actions.date FROM ( SELECT av.id AS uid, av.date as date FROM action_video av WHERE av.date = '2010-06-03' UNION ALL SELECT ac.uid AS uid, ac.date as date"
                                 " FROM fact.action_comment ac WHERE ac.date = '2008-06-03' ) actions JOIN users u ON (u.id = actions.uid)", [
        (None, 0, "id", ["app.users.id"], ["JOIN:(app.users.id = app.action_video.id&fact.action_comment.uid)", "WHERE:app.action_video.date = '2010-06-03'", "WHERE:fact.action_comment.date = '2008-06-03'"]),
        (None, 1, "date", ["app.action_video.date", "fact.action_comment.date"], ["JOIN:(app.users.id = app.action_video.id&fact.action_comment.uid)", "WHERE:app.action_video.date = '2010-06-03'", "WHERE:fact.action_comment.date = '2008-06-03'"])]),
    "three branches": ("INSERT OVERWRITE TABLE target_table SELECT name, id, \"C159\" FROM s_1 UNION ALL SELECT name, id,category FROM s_2 UNION ALL SELECT name, id, \"C160\" FROM s_3 where name=123", [
        ("default.target_table", 0, "name", ["default.s_1.name", "default.s_2.name", "default.s_3.name"], ["WHERE:default.s_3.name = 123"]),
        ("default.target_table", 1, "id", ["default.s_1.id", "default.s_2.id", "default.s_3.id"], ["WHERE:default.s_3.name = 123"]),
        ("default.target_table", 2, "category", ["default.s_2.category"], ["WHERE:default.s_3.name = 123"])]),
    "union with a join branch": ("insert into dest select order_id from g.g_order union all select o.order_id from p.dw_order o join p.passenger q on o.pid = q.pid", [
        ("default.dest", 0, "order_id", ["g.g_order.order_id", "p.dw_order.order_id"], ["JOIN:p.dw_order.pid = p.passenger.pid"])]),
    "scalar query in the select list": ("insert into dw.a select (select max(w) from ods.t2) as m, v from ods.t1", [
        ("dw.a", 0, "m", ["ods.t2.w"], []), ("dw.a", 1, "v", ["ods.t1.v"], [])]),
    "query in a condition": ("insert into dw.a select k from ods.t1 where v in (select w from ods.t2)", [("dw.a", 0, "k", ["ods.t1.k"], ["WHERE:ods.t1.v in (ods.t2.w)"])]),
    "joins in parentheses": ("insert into dw.a select t.k, x.v from (ods.t1 t join ods.t2 x on t.k = x.k)", [
        ("dw.a", 0, "k", ["ods.t1.k"], ["JOIN:ods.t1.k = ods.t2.k"]), ("dw.a", 1, "v", ["ods.t2.v"], ["JOIN:ods.t1.k = ods.t2.k"])]),
    "several inserts": ("from ods.t1 t insert overwrite table dw.a select t.k insert overwrite table dw.b select t.v", [("dw.a", 0, "k", ["ods.t1.k"], []), ("dw.b", 0, "v", ["ods.t1.v"], [])]),
    "star of a table": ("insert into dw.a select t.*, 1 as one from ods.t1 t", [("dw.a", 0, "k", ["ods.t1.k"], []), ("dw.a", 1, "v", ["ods.t1.v"], []), ("dw.a", 2, "one", [], [])]),
    "star without metadata": ("insert into dw.a select * from ods.unknown", [("dw.a", 0, "", ["ods.unknown.*"], [])]),
    "nested, with queries, correlated": ("with w as (select q.c as n from (select c from ods.t) q), w2 as (select n as m from w) insert into dw.a select m, (select max(z.y) from ods.z z where z.i = W2.m) as top from w2", [
        ("dw.a", 0, "m", ["ods.t.c"], ["WHERE:ods.z.i = ods.t.c"]), ("dw.a", 1, "top", ["ods.z.y"], ["WHERE:ods.z.i = ods.t.c"])]),
    "words that are no columns": ("insert into dw.a select cast(t.x as decimal(10,2)) c, sum(v) over (partition by g order by d rows between unbounded preceding and current row) s, extract(year from ts) y, case when b = 'from x, y' then `c` else date '2020-01-01' end e from ods.u t", [
        ("dw.a", 0, "c", ["ods.u.x"], []), ("dw.a", 1, "s", ["ods.u.d", "ods.u.g", "ods.u.v"], []), ("dw.a", 2, "y", ["ods.u.ts"], []), ("dw.a", 3, "e", ["ods.u.b", "ods.u.c"], [])]),
}


@pytest.fixture(scope="module")
def traced(spark):
    jobs = spark.createDataFrame([(i, script) for i, (script, _) in enumerate(CASES.values())], "id long, script string")
    meta = spark.createDataFrame(META, "database_name string, table_name string, column_name string, ordinal int")
    return S.trace_lines(T.table_refs(jobs), meta).collect()


@pytest.mark.parametrize("case", CASES)
def test_lines(traced, case):
    at = list(CASES).index(case)
    got = sorted(((r.to_table, r.pos, r.to_name, r.sources, r.conditions) for r in traced if r.job_id == at), key=repr)
    assert got == sorted(CASES[case][1], key=repr)


def test_expressions_in_full(traced):
    at = list(CASES).index("join with functions")
    assert {r.to_name: r.expr for r in traced if r.job_id == at} == {"name_al": "nvl(app.test.name,0)", "ip": "app.test1.ip"}
    at = list(CASES).index("three branches")
    assert {r.to_name: r.expr for r in traced if r.job_id == at}["category"] == "\"C159\"&default.s_2.category&\"C160\""


def test_nothing_to_trace(spark):
    jobs = spark.createDataFrame([(1, "use x"), (2, "analyze table t"), (3, "")], "id long, script string")
    meta = spark.createDataFrame(META, "database_name string, table_name string, column_name string, ordinal int")
    assert S.trace_lines(T.table_refs(jobs), meta).collect() == []


def test_refresh_traces_only_changed_scripts(spark, tmp_path):
    from tracewell.operators import relations as R

    store, schema = str(tmp_path / "store"), "id long, script string"
    meta = spark.createDataFrame([(*m, i, 1) for i, m in enumerate(META)], "database_name string, table_name string, column_name string, ordinal int, column_id long, table_id int")
    texts = {i: f"insert into dw.a{i % 7} select t.k as x, t.v from ods.t1 t where t.k > {i % 5}" for i in range(60)}
    before = spark.createDataFrame(list(texts.items()), schema)
    first = R.refresh(before, meta, store)
    assert first.count() == 120 and R.stored(before, store, "scripts").count() == 35  # a text is traced once
    changed = {**texts, 3: "insert into dw.a3 select t.v as x from ods.t1 t", 4: None, 60: texts[0]}
    after = spark.createDataFrame(list(changed.items()), schema)
    assert [r.id for r in R.unseen(after, store).filter("script IS NOT NULL").collect()] == [3]
    second = R.refresh(after, meta, store)
    whole = R.refresh(after, meta, str(tmp_path / "other"))
    assert sorted(map(repr, second.collect())) == sorted(map(repr, whole.collect()))
    got = {(r.job_id, r.src, r.dst, r.change) for r in R.changes(first, second).collect()}
    assert got == {(3, "ods.t1.v", "dw.a3.x", "added"), (3, "ods.t1.k", "dw.a3.x", "removed"), (3, "ods.t1.v", "dw.a3.v", "removed"),
                   (4, "ods.t1.k", "dw.a4.x", "removed"), (4, "ods.t1.v", "dw.a4.v", "removed"), (60, "ods.t1.k", "dw.a0.x", "added"), (60, "ods.t1.v", "dw.a0.v", "added")}
    assert R.unseen(before, store).count() == 0 and R.refresh(before, meta, store).count() == 120  # texts that come back cost nothing
    assert R.unseen(before, store, "metadata of tomorrow").count() == 35
    row = R.relations(second, meta).filter("job_id = 3").first()
    assert (row.src, row.dst, row.from_column_id, row.from_table_id, row.column_id, row.condition) == ("ods.t1.v", "dw.a3.x", 4, 1, None, "")


def test_steps_are_kept_in_columns_and_not_as_checkpoints(spark, monkeypatch):
    """Tokens, sources and expressions take far more room as rows of a checkpoint than as compressed columns."""
    def refused(self, *args, **more):
        raise AssertionError("a checkpoint")

    jobs = spark.createDataFrame([(1, "insert into dw.d select a.k, sum(b.v) as v from ods.a a join ods.b b on a.k = b.k")], "id long, script string")
    monkeypatch.setattr(type(jobs), "checkpoint", refused)
    lines = S.trace_lines(T.table_refs(jobs), spark.createDataFrame([], "database_name string, table_name string, column_name string"))
    assert sorted((r.to_table, r.pos, r.to_name, tuple(r.sources)) for r in lines.collect()) == [("dw.d", 0, "k", ("ods.a.k",)), ("dw.d", 1, "v", ("ods.b.v",))]
