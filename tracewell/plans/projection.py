"""Projection and filter queries."""
from pyspark.sql import functions as F

from tracewell.registry import query
from tracewell.sources import run_sql, table


@query("prj_select", """
SELECT l_orderkey, l_linenumber, l_quantity AS qty, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_returnflag || l_linestatus AS status FROM lineitem
""")
def prj_select(spark, d):
    return table(spark, d, "lineitem").alias("l").select(
        "l.l_orderkey", "l.l_linenumber", F.col("l.l_quantity").alias("qty"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6).alias("charge"),
        F.concat("l_returnflag", "l_linestatus").alias("status"))


@query("prj_star", "SELECT *, c_acctbal < 0 AS overdrawn FROM customer")
def prj_star(spark, d):
    return table(spark, d, "customer").alias("t").select("t.*", (F.col("c_acctbal") < 0).alias("overdrawn"))


@query("prj_regex_columns", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def prj_regex_columns(spark, d):
    df = table(spark, d, "lineitem")
    return df.select(df.colRegex("`l_(order|part|supp)key`"))


@query("prj_nested_access", """
SELECT event_id, event_type AS kind, split_part(event_type, 'i', 1) AS head, CAST(NULL AS VARCHAR) AS beyond,
       CAST(json_extract_string(props, '$.k') AS INT) AS k, concat(event_type, '|', upper(event_type)) AS names FROM events
""")
def prj_nested_access(spark, d):
    nested = table(spark, d, "events").select(
        "event_id", F.struct(F.col("event_type").alias("kind"), "value").alias("s"), F.split("event_type", "i").alias("parts"),
        F.from_json("props", "map<string,int>").alias("m"),
        F.array(F.struct(F.col("event_type").alias("name")), F.struct(F.upper("event_type").alias("name"))).alias("items"))
    return nested.select("event_id", "s.kind", F.get("parts", F.lit(0)).alias("head"), F.get("parts", F.lit(9)).alias("beyond"),
                         F.try_element_at("m", F.lit("k")).alias("k"), F.array_join("items.name", "|").alias("names"))


@query("flt_compare", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > 1000 AND o_totalprice <= 400000 AND o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
""")
def flt_compare(spark, d):
    date = F.col("o_orderdate")
    return table(spark, d, "orders").filter(
        (F.col("o_totalprice") > 1000) & (F.col("o_totalprice") <= 400000) & (F.col("o_orderstatus") != "P")
        & (date >= F.lit("1996-01-01").cast("timestamp_ntz")) & (date < F.lit("2000-01-01").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_totalprice")


@query("flt_nullsafe", """
SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') IS NOT DISTINCT FROM nullif(l_linestatus, 'O') AS same,
       nullif(l_returnflag, 'N') IS DISTINCT FROM nullif(l_linestatus, 'O') AS differs
FROM lineitem WHERE nullif(l_returnflag, 'N') IS NOT DISTINCT FROM NULL
""")
def flt_nullsafe(spark, d):
    flag, status = F.expr("nullif(l_returnflag, 'N')"), F.expr("nullif(l_linestatus, 'O')")
    return table(spark, d, "lineitem").filter(flag.eqNullSafe(F.lit(None))).select(
        "l_orderkey", "l_linenumber", flag.eqNullSafe(status).alias("same"), (~flag.eqNullSafe(status)).alias("differs"))


@query("flt_boolean", """
SELECT CAST(a AND b AS VARCHAR) AS both, CAST(a OR b AS VARCHAR) AS either, CAST(NOT a AS VARCHAR) AS negated, count(*) AS n FROM (
  SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS a, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax > 0.04 END AS b FROM lineitem) GROUP BY ALL
""")
def flt_boolean(spark, d):
    a = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    b = F.when(F.col("l_tax") != 0, F.col("l_tax") > 0.04)
    return table(spark, d, "lineitem").groupBy(
        (a & b).cast("string").alias("both"), (a | b).cast("string").alias("either"), (~a).cast("string").alias("negated")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("flt_in", """
SELECT CASE WHEN p_size IN (1, 5, NULL) THEN 'hit' WHEN NOT (p_size IN (1, 5, NULL)) THEN 'miss' ELSE 'unknown' END AS answer, count(*) AS n
FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD') GROUP BY 1
""")
def flt_in(spark, d):
    hit = F.col("p_size").isin(1, 5, None)
    return (table(spark, d, "part").filter(F.col("p_type").isin("ECONOMY", "PROMO", "STANDARD"))
            .groupBy(F.when(hit, "hit").when(~hit, "miss").otherwise("unknown").alias("answer")).agg(F.count(F.lit(1)).alias("n")))


@query("flt_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.03 AND 0.06")
def flt_between(spark, d):
    return (table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 20) & ~F.col("l_discount").between(0.03, 0.06))
            .select("l_orderkey", "l_linenumber", "l_quantity"))


@query("flt_null", """
SELECT id, flag, amount, tax FROM (
  SELECT l_orderkey AS id, nullif(l_returnflag, 'N') AS flag, nullif(l_quantity, 1) AS amount, nullif(l_tax, 0) AS tax FROM lineitem)
WHERE (CASE WHEN flag IS NULL THEN 0 ELSE 1 END) + (CASE WHEN amount IS NULL THEN 0 ELSE 1 END) + (CASE WHEN tax IS NULL THEN 0 ELSE 1 END) >= 2 AND amount IS NOT NULL
""")
def flt_null(spark, d):
    df = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS id", "nullif(l_returnflag, 'N') AS flag", "nullif(l_quantity, 1) AS amount", "nullif(l_tax, 0) AS tax")
    return df.dropna(thresh=2, subset=["flag", "amount", "tax"]).filter(F.col("amount").isNotNull())


@query("fn_str_pred", """
SELECT p_partkey, p_name LIKE '%ing' AS a, p_name LIKE 's_all%' AS b, regexp_matches(p_name, '(red|blue)\\s') AS c, starts_with(p_name, 'red') AS d,
       ends_with(p_name, 'get') AS e, contains(p_name, 'll') AS f
FROM part WHERE p_brand LIKE 'Brand#1%' OR NOT regexp_matches(p_type, '^E')
""")
def fn_str_pred(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").filter(F.col("p_brand").like("Brand#1%") | ~F.col("p_type").rlike("^E")).select(
        "p_partkey", name.like("%ing").alias("a"), name.like("s_all%").alias("b"), name.rlike(r"(red|blue)\s").alias("c"),
        name.startswith("red").alias("d"), name.endswith("get").alias("e"), name.contains("ll").alias("f"))


@query("flt_having", """
SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING avg(l_quantity) > 25 AND max(l_discount) >= 0.1
""")
def flt_having(spark, d):
    grouped = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"), F.max("l_discount").alias("top"))
    return grouped.filter("mean > 25 AND top >= 0.1").select("l_suppkey", "n")
