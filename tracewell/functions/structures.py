"""Array, map, struct and cast functions."""
from pyspark.sql import functions as F

from tracewell.registry import query
from tracewell.sources import table


@query("fn_array", """
SELECT l_orderkey, l_linenumber, l_partkey, list_contains([l_partkey, l_suppkey, l_linenumber], 5) AS has5, CAST(3 AS INT) AS n, array_to_string(list_sort([l_partkey, l_suppkey, l_linenumber]), ',') AS sorted,
       array_to_string(list_reverse_sort([l_partkey, l_suppkey, l_linenumber]), ',') AS falling, CAST(-1 AS INT) AS none FROM lineitem
""")
def fn_array(spark, d):
    a = F.array("l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_contains(a, F.lit(5)).alias("has5"), F.size(a).alias("n"), text(F.sort_array(a)).alias("sorted"), text(F.sort_array(a, False)).alias("falling"),
        F.coalesce(F.size(F.lit(None).cast("array<int>")), F.lit(-1)).alias("none"))


@query("fn_map", """
SELECT user_id, array_to_string(list_sort(list(event_type)), ',') AS types, CAST(sum(n) AS BIGINT) AS total, max(n) FILTER (event_type = 'click') AS clicks, array_to_string(list_sort(list(concat(event_type, ':', n))), ',') AS text
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1
""")
def fn_map(spark, d):
    """Event counts per type as a map, one entry per type."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    text = F.array_join(F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    parsed = maps.withColumn("text", text).withColumn("p", F.str_to_map("text", F.lit(","), F.lit(":"))).withColumn("one", F.create_map(F.lit("user"), "user_id"))
    return parsed.select(F.col("one")["user"].alias("user_id"), F.array_join(F.sort_array(F.map_keys("p")), ",").alias("types"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                         F.try_element_at("p", F.lit("click")).cast("bigint").alias("clicks"), "text")


@query("fn_struct", "SELECT c_custkey, c_name AS who, c_acctbal AS amount, c_mktsegment AS segment, concat('{\"a\":', c_nationkey, ',\"b\":\"', c_mktsegment, '\"}') AS text FROM customer")
def fn_struct(spark, d):
    nested = table(spark, d, "customer").select(
        "c_custkey", F.struct("c_name", F.struct("c_acctbal", "c_mktsegment").alias("inner")).alias("s"), F.named_struct(F.lit("a"), "c_nationkey", F.lit("b"), "c_mktsegment").alias("t"))
    return nested.select("c_custkey", F.col("s.c_name").alias("who"), F.col("s.inner.c_acctbal").alias("amount"), F.col("s.inner.c_mktsegment").alias("segment"), F.to_json("t").alias("text"))


@query("fn_cast", """
SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS i, CAST(trunc(o_totalprice) AS BIGINT) AS b, CAST(o_custkey % 100 AS INT) AS ti, CAST(o_custkey % 1000 AS INT) AS si, round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 0) AS f, CAST(o_custkey AS DOUBLE) AS db,
       CAST(round(o_totalprice, 0) AS DOUBLE) AS de, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, o_custkey <> 0 AS bo, CAST(o_custkey AS VARCHAR) AS s, hex(o_orderstatus) AS bi, NULL::INT AS bad FROM orders
""")
def fn_cast(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "int(o_totalprice) AS i", "bigint(o_totalprice) AS b", "int(tinyint(o_custkey % 100)) AS ti", "int(smallint(o_custkey % 1000)) AS si", "round(double(float(o_totalprice)), 0) AS f", "double(o_custkey) AS db",
        "double(decimal(o_totalprice)) AS de", "string(date(o_orderdate)) AS d", "date_format(timestamp(o_orderdate), 'yyyy-MM-dd HH:mm:ss') AS t", "boolean(o_custkey) AS bo", "string(o_custkey) AS s", "hex(binary(o_orderstatus)) AS bi",
        "try_cast(o_orderpriority AS int) AS bad")
