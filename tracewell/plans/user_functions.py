"""User-defined function queries."""
from pyspark.sql import functions as F

from tracewell.operators import udfs as U
from tracewell.registry import query
from tracewell.sources import run_sql, table


@query("udf_scalar", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + nullif(l_tax, 0)), 6) AS charge FROM lineitem")
def udf_scalar(spark, d):
    df = table(spark, d, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round(U.net_charge("l_extendedprice", "l_discount", "tax"), 6).alias("charge"))


@query("udaf_typed", "SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 6) AS geometric_mean, count(*) AS n FROM lineitem GROUP BY 1")
def udaf_typed(spark, d):
    out = U.geometric_mean(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.withColumn("geometric_mean", F.round("geometric_mean", 6))


@query("udtf_generate", """
SELECT p_partkey, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INT) AS pos, unnest(string_split(p_name, ' ')) AS word, CAST(length(unnest(string_split(p_name, ' '))) AS INT) AS n_chars FROM part
""")
def udtf_generate(spark, d):
    name = U.register_word_rows(spark)
    names = table(spark, d, "part").select("p_partkey", "p_name")
    return run_sql(spark, d, f"SELECT key AS p_partkey, pos, word, n_chars FROM {name}(TABLE(part_names))", part_names=names)


@query("udf_map_partitions", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def udf_map_partitions(spark, d):
    return U.flag_counts(table(spark, d, "lineitem"))


@query("udf_map_elements", "SELECT p_partkey, concat(upper(p_brand), ':', p_size) AS label FROM part")
def udf_map_elements(spark, d):
    return U.map_elements(table(spark, d, "part"))


@query("udf_typed_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE list_sum(list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: CAST(c AS INT))) % 2 = 0")
def udf_typed_filter(spark, d):
    return U.typed_filter(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("udf_map_groups", """
SELECT user_id, count(*) AS n_days, round(regr_slope(n, day_no), 6) + 0.0 AS slope FROM (
  SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1
""")
def udf_map_groups(spark, d):
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    daily = table(spark, d, "events").groupBy("user_id", day.alias("day_no")).agg(F.count(F.lit(1)).alias("n"))
    return U.daily_trend(daily).withColumn("slope", F.round("slope", 6) + 0.0)


@query("udf_append_columns", "SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1")
def udf_append_columns(spark, d):
    return table(spark, d, "part").withColumn("band", U.size_band("p_size")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))
