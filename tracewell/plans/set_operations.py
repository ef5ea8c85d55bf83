"""Set operations, subqueries and generators."""
from pyspark.sql import functions as F

from tracewell.operators.joins import not_in
from tracewell.registry import query
from tracewell.sources import run_sql, table


def keys(spark, d, name, column, alias="k", where=None):
    df = table(spark, d, name)
    return (df.filter(where) if where else df).select(F.col(column).alias(alias))


@query("set_union_all", "SELECT c_nationkey AS k, c_acctbal AS amount FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def set_union_all(spark, d):
    """An int column is widened to bigint by position."""
    return (table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("amount"))
            .union(table(spark, d, "supplier").select("s_suppkey", "s_acctbal")))


@query("set_union", "SELECT o_custkey AS k FROM orders UNION SELECT l_partkey FROM lineitem")
def set_union(spark, d):
    """Each side is made distinct before the union is."""
    return keys(spark, d, "orders", "o_custkey").distinct().union(keys(spark, d, "lineitem", "l_partkey").distinct()).distinct()


@query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(spark, d):
    return keys(spark, d, "orders", "o_custkey", where="o_orderstatus = 'P'").distinct().intersect(
        keys(spark, d, "lineitem", "l_partkey", where="l_returnflag = 'R'").distinct())


@query("set_except", "SELECT l_partkey AS k FROM lineitem EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return keys(spark, d, "lineitem", "l_partkey").distinct().subtract(keys(spark, d, "orders", "o_custkey").distinct())


CTE = """
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000),
per AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big GROUP BY o_custkey)
SELECT c_custkey, c_name, n, top FROM per JOIN customer ON c_custkey = o_custkey
"""


@query("sub_cte", CTE)
def sub_cte(spark, d):
    return run_sql(spark, d, CTE, "orders", "customer")


FROM = "SELECT t.k, t.n FROM (SELECT l_suppkey, count(*) FROM lineitem GROUP BY l_suppkey) AS t(k, n) WHERE t.n > 500"


@query("sub_from", FROM)
def sub_from(spark, d):
    return run_sql(spark, d, FROM, "lineitem")


SCALAR = """
SELECT o_orderkey, o_totalprice - (SELECT min(o_totalprice) FROM orders) AS above_min,
       (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS top_line
FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
"""


@query("sub_scalar", SCALAR.replace("o_totalprice - (SELECT min(o_totalprice) FROM orders)", "round(o_totalprice - (SELECT min(o_totalprice) FROM orders), 4)"))
def sub_scalar(spark, d):
    return run_sql(spark, d, SCALAR, "orders", "lineitem").withColumn("above_min", F.round("above_min", 4))


IN = "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)"
NOT_IN = "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)"


@query("sub_in", IN)
def sub_in(spark, d):
    return run_sql(spark, d, IN, "part", "lineitem")


@query("sub_not_in", NOT_IN)
def sub_not_in(spark, d):
    sold = table(spark, d, "lineitem").filter("l_quantity > 48").select("l_partkey")
    return not_in(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", sold)


@query("sub_not_in_null", "SELECT (SELECT count(*) FROM part WHERE p_size NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)) AS with_null, (SELECT count(*) FROM part WHERE p_size NOT IN (SELECT s_nationkey FROM supplier)) AS without_null")
def sub_not_in_null(spark, d):
    """One null among the values makes NOT IN unknown for every row."""
    parts, nations = table(spark, d, "part").select("p_size"), table(spark, d, "supplier")
    some = not_in(parts, "p_size", nations.selectExpr("nullif(s_nationkey, 3) AS k")).agg(F.count(F.lit(1)).alias("with_null"))
    return some.crossJoin(not_in(parts, "p_size", nations.select("s_nationkey")).agg(F.count(F.lit(1)).alias("without_null")))


EXISTS = "SELECT c_custkey FROM customer c WHERE {no}EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * {factor})"


@query("sub_exists", EXISTS.format(no="", factor=60))
def sub_exists(spark, d):
    return run_sql(spark, d, EXISTS.format(no="", factor=60), "customer", "orders")


@query("sub_not_exists", EXISTS.format(no="NOT ", factor=60))
def sub_not_exists(spark, d):
    return run_sql(spark, d, EXISTS.format(no="NOT ", factor=60), "customer", "orders")


@query("gen_explode", """
SELECT p_partkey, 'list' AS kind, CAST(i AS INT) AS pos, NULL AS key, w AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part)
UNION ALL SELECT p_partkey, 'map', NULL, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'map', NULL, 'type', p_type FROM part
UNION ALL SELECT p_partkey, 'outer', NULL, NULL, CASE WHEN p_size > 25 THEN p_type END FROM part
""")
def gen_explode(spark, d):
    parts = table(spark, d, "part")
    lists = parts.select("p_partkey", F.lit("list").alias("kind"), F.posexplode(F.split("p_name", " ")).alias("pos", "value")).withColumn("key", F.lit(None).cast("string"))
    maps = parts.select("p_partkey", F.lit("map").alias("kind"), F.explode(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")).alias("key", "value")).withColumn("pos", F.lit(None).cast("int"))
    some = F.when(F.col("p_size") > 25, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    outer = parts.select("p_partkey", F.lit("outer").alias("kind"), F.explode_outer(some).alias("value")).withColumn("key", F.lit(None).cast("string")).withColumn("pos", F.lit(None).cast("int"))
    return lists.unionByName(maps).unionByName(outer)


@query("gen_posexplode_outer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 0 END::INT AS pos, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer")
def gen_posexplode_outer(spark, d):
    some = F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.posexplode_outer(some).alias("pos", "segment"))


@query("gen_inline_stack", """
SELECT l_orderkey, l_linenumber, l_partkey, 'a' AS label, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'b', l_tax FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'c', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL, NULL FROM lineitem WHERE l_quantity <= 25
""")
def gen_inline_stack(spark, d):
    base = table(spark, d, "lineitem")
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    stacked = base.selectExpr(*ids, "stack(2, 'a', l_quantity, 'b', l_tax) AS (label, amount)")
    structs = F.when(F.col("l_quantity") > 25, F.array(F.struct(F.lit("c").alias("label"), F.col("l_discount").alias("amount"))))
    inline = base.filter("l_quantity > 25").select(*ids, F.inline(F.array(F.struct(F.lit("c").alias("label"), F.col("l_discount").alias("amount")))))
    small = base.filter("l_quantity <= 25")
    return (stacked.unionByName(inline).unionByName(small.select(*ids, F.inline(F.array(F.struct(F.lit("c").alias("label"), F.col("l_discount").alias("amount"))))))
            .unionByName(small.select(*ids, F.inline_outer(structs))))


@query("gen_lateral_view", """
SELECT p_partkey, w AS word, CAST(i AS INT) AS pos, c AS letter FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part), (SELECT unnest(['x', 'y']) AS c)
""")
def gen_lateral_view(spark, d):
    return run_sql(spark, d, """
        SELECT p_partkey, word, pos, letter FROM part
        LATERAL VIEW posexplode(split(p_name, ' ')) w AS pos, word
        LATERAL VIEW OUTER explode(array('x', 'y')) l AS letter
    """, "part")


@query("gen_json_tuple", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events")
def gen_json_tuple(spark, d):
    return table(spark, d, "events").select("event_id", F.json_tuple("props", "k", "none").alias("k", "missing"))
