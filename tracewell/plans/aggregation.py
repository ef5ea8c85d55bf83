"""Aggregation and reshaping queries."""
from pyspark.sql import functions as F

from tracewell.operators.aggregates import count_min_estimate, count_min_size, exact_percentiles, frequency_percentiles, interval_of, one_per_key
from tracewell.operators.skew import lookup_join
from tracewell.registry import query
from tracewell.sources import run_sql, table


@query("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 6) AS mean, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
def agg_global(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.avg("l_extendedprice"), 6).alias("mean"),
        F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))


@query("agg_basic", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
       round(avg(l_quantity), 8) AS avg_qty, round(avg(l_discount), 8) AS avg_disc, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2
""")
def agg_basic(spark, d):
    price = F.col("l_extendedprice")
    return (table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(price), 4).alias("sum_base"),
        F.round(F.sum(price * (1 - F.col("l_discount"))), 4).alias("sum_disc"), F.round(F.mean("l_quantity"), 8).alias("avg_qty"),
        F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.min(price).alias("lo"), F.max(price).alias("hi"), F.count("*").alias("n")))


@query("agg_distinct", """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_suppkey, l_linenumber)) AS pairs, sum(DISTINCT l_quantity) AS qty, avg(DISTINCT l_quantity) AS mean, count(*) AS n
FROM lineitem GROUP BY 1
""")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_suppkey", "l_linenumber").alias("pairs"),
        F.sum_distinct("l_quantity").alias("qty"), F.expr("avg(DISTINCT l_quantity)").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("agg_group_expr", "SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority AS p, o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_expr(spark, d):
    return run_sql(spark, d, "SELECT year(o_orderdate) AS y, o_orderpriority AS p, o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY 1, p, o_totalprice > 100000", "orders")


SETS = "SELECT l_returnflag, l_linestatus, {extra}count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY {how}"


@query("agg_grouping_sets", SETS.format(extra="", how="GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())"))
def agg_grouping_sets(spark, d):
    df = table(spark, d, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return df.groupingSets([[flag, status], [status], []], flag, status).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("agg_cube", SETS.format(extra="", how="CUBE (l_returnflag, l_linestatus)"))
def agg_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("agg_rollup", SETS.format(extra="", how="ROLLUP (l_returnflag, l_linestatus)"))
def agg_rollup(spark, d):
    return run_sql(spark, d, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "lineitem")


@query("agg_grouping_id", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g1, CAST(grouping(l_linestatus) AS INT) AS g2, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_grouping_id(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"),
        F.grouping_id("l_returnflag", "l_linestatus").alias("gid"), F.count(F.lit(1)).alias("n"))


@query("agg_first_last", """
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type,
       arg_min(value, (ts, event_id)) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY 1
""")
def agg_first_last(spark, d):
    at = F.struct("ts", "event_id")
    bought = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"),
        F.min_by(F.when(bought, F.col("value")), F.when(bought, at)).alias("first_purchase"))


@query("agg_first_last_any", "SELECT o_orderstatus, 1 AS first_found, 1 AS last_found FROM orders GROUP BY 1")
def agg_first_last_any(spark, d):
    """first and last take any row's value: each must be a status of its own group."""
    status = F.col("o_orderstatus")
    out = table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.first(status, ignorenulls=True).alias("a"), F.last(status, ignorenulls=True).alias("b"),
        F.first_value(status).alias("c"), F.last_value(status).alias("e"))
    return out.select("o_orderstatus", ((F.col("a") == status) & (F.col("c") == status)).cast("int").alias("first_found"),
                      ((F.col("b") == status) & (F.col("e") == status)).cast("int").alias("last_found"))


@query("agg_moments", """
SELECT l_returnflag, round(var_samp(l_quantity), 6) AS variance, round(var_pop(l_quantity), 6) AS var_pop, round(stddev_samp(l_quantity), 6) AS std, round(stddev_pop(l_quantity), 6) AS std_pop,
       round((avg(power(l_quantity, 3)) - 3 * avg(l_quantity) * avg(power(l_quantity, 2)) + 2 * power(avg(l_quantity), 3)) / power(var_pop(l_quantity), 1.5), 6) AS skewness,
       round(kurtosis_pop(l_quantity), 6) AS kurtosis FROM lineitem GROUP BY 1
""")
def agg_moments(spark, d):
    q = "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.variance(q), 6).alias("variance"), F.round(F.var_pop(q), 6).alias("var_pop"), F.round(F.stddev(q), 6).alias("std"),
        F.round(F.stddev_pop(q), 6).alias("std_pop"), F.round(F.skewness(q), 6).alias("skewness"), F.round(F.kurtosis(q), 6).alias("kurtosis"))


@query("agg_bivariate", """
SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 8) AS corr, round(covar_pop(l_quantity, l_discount), 8) AS cov_pop, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov_samp FROM lineitem GROUP BY 1
""")
def agg_bivariate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("corr"), F.round(F.covar_pop("l_quantity", "l_discount"), 8).alias("cov_pop"),
        F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("cov_samp"))


@query("agg_percentile", """
SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1
""")
def agg_percentile(spark, d):
    """Fifty distinct quantities, each with its frequency."""
    return frequency_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", {"p25": 0.25, "median": 0.5, "p99": 0.99})


@query("agg_percentile_many", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY 1")
def agg_percentile_many(spark, d):
    """Almost every price is distinct, so the places are found by running counts."""
    out = exact_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "median": 0.5})
    return out.select("l_returnflag", F.round("p10", 6).alias("p10"), F.round("median", 6).alias("median"))


@query("agg_percentile_approx", "SELECT l_returnflag, count(*) AS n, TRUE AS within FROM lineitem GROUP BY 1")
def agg_percentile_approx(spark, d):
    """The rank of an approximate quantile lies within n / accuracy of the exact one."""
    df = table(spark, d, "lineitem")
    estimates = df.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"), F.approx_percentile("l_extendedprice", 0.9, 1000).alias("p90"))
    ranks = df.join(estimates, "l_returnflag").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") <= F.col("median")).alias("r50"), F.count_if(F.col("l_extendedprice") <= F.col("p90")).alias("r90"))
    room = F.col("n") / 1000 + 1
    return ranks.select("l_returnflag", "n", ((F.abs(F.col("r50") - 0.5 * F.col("n")) <= room) & (F.abs(F.col("r90") - 0.9 * F.col("n")) <= room)).alias("within"))


@query("agg_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, TRUE AS within FROM lineitem GROUP BY 1")
def agg_approx_distinct(spark, d):
    """HyperLogLog++ against the exact count, three standard errors apart at most."""
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("estimate"))
    return out.select("l_returnflag", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 3 * 0.02 * F.col("exact")).alias("within"))


BORDERS = (0.0, 10.0, 25.0, 40.0, 50.0)


@query("agg_approx_distinct_intervals", """
SELECT CAST(CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS INT) AS interval_no, count(DISTINCT l_extendedprice) AS exact, TRUE AS within
FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1
""")
def agg_approx_distinct_intervals(spark, d):
    out = (table(spark, d, "lineitem").withColumn("interval_no", interval_of("l_quantity", BORDERS)).filter("interval_no is not null")
           .groupBy("interval_no").agg(F.count_distinct("l_extendedprice").alias("exact"), F.approx_count_distinct("l_extendedprice", 0.02).alias("estimate")))
    return out.select("interval_no", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 3 * 0.02 * F.col("exact")).alias("within"))


@query("agg_collect", """
SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS types, array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ';') AS days, count(*) AS n FROM events GROUP BY 1
""")
def agg_collect(spark, d):
    """Sets are bounded by the types and days there are; the list of days is taken after they were made distinct."""
    daily = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.collect_set("event_type").alias("types"), F.count(F.lit(1)).alias("n"))
    return daily.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ";").alias("types"),
        F.array_join(F.sort_array(F.collect_list("day")), ";").alias("days"), F.sum("n").alias("n"))


@query("agg_cms", "SELECT l_returnflag, count(*) AS total, CAST(5 AS BIGINT) AS depth, CAST(200 AS BIGINT) AS width FROM lineitem GROUP BY 1")
def agg_cms(spark, d):
    """Count-min sketches of the parts per return flag: what they counted, and the size that error and confidence ask for."""
    sketches = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.hex(F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(42))).alias("sketch"))

    def number(first, digits):  # the head of the binary form: version, total, depth, width
        return F.conv(F.substring("sketch", first, digits), 16, 10).cast("bigint")

    return sketches.select("l_returnflag", number(9, 16).alias("total"), number(25, 8).alias("depth"), number(33, 8).alias("width"))


@query("agg_cms_estimates", "SELECT l_returnflag, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS total, TRUE AS never_below, TRUE AS within FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def agg_cms_estimates(spark, d):
    """Every part's count out of the sketch of its flag: at or above the true count, and within the error for the asked share of parts."""
    error, share = 0.01, 0.95
    df = table(spark, d, "lineitem")
    sketches = df.groupBy("l_returnflag").agg(F.hex(F.count_min_sketch("l_partkey", F.lit(error), F.lit(share), F.lit(42))).alias("sketch"))
    parts = lookup_join(df.groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n")), sketches, ["l_returnflag"], small=True)
    read = parts.select("l_returnflag", "n", count_min_size(F.col("sketch"), "total").alias("total"), count_min_estimate(F.col("sketch"), F.col("l_partkey")).alias("estimate"))
    return read.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("total"), F.min(F.col("estimate") >= F.col("n")).alias("never_below"),
        (F.count_if(F.col("estimate") <= F.col("n") + error * F.col("total")) >= share * F.count(F.lit(1))).alias("within"))


@query("agg_case_filter", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_custkey END) AS big_customers,
       round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 4) AS open_value FROM orders GROUP BY 1
""")
def agg_case_filter(spark, d):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count_if(status == "F").alias("done"), F.count_distinct(F.when(price > 200000, F.col("o_custkey"))).alias("big_customers"),
        F.round(F.sum(F.when(status == "O", price).otherwise(0.0)), 4).alias("open_value"))


@query("rsh_pivot", """
SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 4) AS "O_qty", CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 END) AS BIGINT) AS "O_n",
       round(sum(l_quantity) FILTER (l_linestatus = 'F'), 4) AS "F_qty", CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 END) AS BIGINT) AS "F_n" FROM lineitem GROUP BY 1
""")
def rsh_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.sum("l_quantity"), 4).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("rsh_expand", """
SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS measure, l_discount AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem
""")
def rsh_expand(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return df.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["discount", "tax"], "measure", "amount")


@query("rsh_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linenumber FROM lineitem")
def rsh_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber").distinct()


@query("rsh_dedup_keys", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1
""")
def rsh_dedup_keys(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return one_per_key(df, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("rsh_drop_duplicates", "SELECT l_orderkey, l_linenumber, 1 AS found FROM lineitem GROUP BY 1, 2")
def rsh_drop_duplicates(spark, d):
    kept = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").dropDuplicates(["l_orderkey", "l_linenumber"])
    return kept.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") >= 0, 1).alias("found"))
