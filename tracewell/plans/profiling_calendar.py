"""Profiling, calendar and number queries."""
from pyspark.sql import functions as F

from tracewell.operators import profiling as P
from tracewell.operators.skew import lookup_join
from tracewell.registry import query
from tracewell.sources import table
from tracewell.sources.tables import TABLES
from tracewell.storage import keep


@query("prof_table_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, TRUE AS has_size FROM {t}" for t in TABLES))
def prof_table_stats(spark, d):
    """Rows and bytes per table, the bytes from the files' metadata."""
    out = None
    for name in TABLES:
        files = table(spark, d, name).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).groupBy("p").agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("n"))
        one = files.agg(F.sum("n").alias("n_rows"), (F.sum("s") > 0).alias("has_size")).select(F.lit(name).alias("table_name"), "n_rows", "has_size")
        out = one if out is None else out.unionByName(one)
    return out


def _stats_sql(numbers, wholes, texts):
    parts = [f"""SELECT '{c}' AS column_name, count(*) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_nulls, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS DOUBLE) AS min_number, CAST(max({c}) AS DOUBLE) AS max_number,
        {f"CAST(min({c}) AS DECIMAL(20,0))" if c in wholes else "NULL::DECIMAL(20,0)"} AS min_integer, {f"CAST(max({c}) AS DECIMAL(20,0))" if c in wholes else "NULL::DECIMAL(20,0)"} AS max_integer,
        NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text, NULL::DOUBLE AS avg_length, NULL::INT AS max_length FROM part""" for c in numbers]
    parts += [f"""SELECT '{c}', count(*), CAST(count(*) - count({c}) AS BIGINT), count(DISTINCT {c}), NULL, NULL, NULL, NULL, min({c}), max({c}), round(avg(length({c})), 6), CAST(max(length({c})) AS INT) FROM part""" for c in texts]
    return " UNION ALL ".join(parts)


@query("prof_column_stats", _stats_sql(["p_partkey", "p_size", "p_retailprice"], ["p_partkey", "p_size"], ["p_name", "p_brand", "p_type"]))
def prof_column_stats(spark, d):
    return P.column_stats(table(spark, d, "part"))


@query("prof_histogram", """
SELECT CAST(bin AS INT) AS bin, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(DISTINCT l_extendedprice) AS ndv, count(*) AS height
FROM (SELECT l_extendedprice, ntile(20) OVER (ORDER BY l_extendedprice) AS bin FROM lineitem) GROUP BY 1
""")
def prof_histogram(spark, d):
    return P.equi_height_histogram(table(spark, d, "lineitem"), "l_extendedprice", 20)


@query("prof_quantile_summary", "SELECT q, TRUE AS within FROM (VALUES (0.1), (0.5), (0.9)) t(q)".replace("(0.1), (0.5), (0.9)", "(0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)"))
def prof_quantile_summary(spark, d):
    """Quantiles from a mergeable summary; each one's rank must lie within the error bound."""
    df = table(spark, d, "lineitem")
    error, points = 0.005, [0.1, 0.5, 0.9]
    found = df.approxQuantile("l_extendedprice", points, error)
    value = F.col("l_extendedprice")
    ranks = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(value <= v).alias(f"r{i}") for i, v in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(q).alias("q"), (F.abs(F.col(f"r{i}") - q * F.col("n")) <= error * F.col("n") + 1).alias("within")) for i, q in enumerate(points)])
    return ranks.select(F.inline(rows))


@query("prof_summary_merge", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, TRUE AS ranks_within, TRUE AS customers_within FROM orders GROUP BY 1, 2
""")
def prof_summary_merge(spark, d):
    """Months out of summaries kept per day and priority; each quantile's true rank and the number of customers must lie within the error."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_totalprice", "o_custkey")
    month = F.to_date(F.date_trunc("month", "day")).alias("month")
    daily = keep(P.summaries(orders, ["day", "o_orderpriority"], "o_totalprice", "o_custkey"))
    points, error = (0.1, 0.5, 0.9), 0.02
    monthly = P.merged(daily, [month, F.col("o_orderpriority")]).select(
        "month", "o_orderpriority", F.hll_sketch_estimate("distinct").alias("estimate"),
        *[F.kll_sketch_get_quantile_double("quantiles", F.lit(q)).alias(f"q{i}") for i, q in enumerate(points)])
    ranks = lookup_join(orders.withColumn("month", month), monthly, ["month", "o_orderpriority"], small=True).groupBy("month", "o_orderpriority", "estimate").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), *[F.count_if(F.col("o_totalprice") <= F.col(f"q{i}")).alias(f"r{i}") for i in range(len(points))])
    near = F.lit(True)
    for i, q in enumerate(points):
        near = near & (F.abs(F.col(f"r{i}") - q * F.col("n")) <= error * F.col("n") + 1)
    return ranks.select("month", "o_orderpriority", "n", "customers", near.alias("ranks_within"),
                        (F.abs(F.col("estimate") - F.col("customers")) <= 0.05 * F.col("customers") + 1).alias("customers_within"))


BOUNDS = "SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders"


@query("cal_dimension", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(date_trunc('quarter', day), '%Y-%m-%d') AS quarter_start, strftime(date_trunc('quarter', day) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS quarter_end,
       strftime(date_trunc('week', day), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', day) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end, strftime(last_day(day), '%Y-%m-%d') AS month_end,
       (year(day) % 4 = 0 AND year(day) % 100 <> 0) OR year(day) % 400 = 0 AS is_leap, concat(year(day), ' Q', quarter(day)) AS label
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM ({BOUNDS}))
""")
def cal_dimension(spark, d):
    bounds = table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    days = bounds.select(F.explode(P.calendar(F.col("lo"), F.col("hi"))).alias("day"))
    quarter, week, year = F.to_date(F.date_trunc("quarter", "day")), P.week_start("day"), F.year("day")
    text = "yyyy-MM-dd"
    return days.select(
        F.date_format("day", text).alias("day"), F.date_format(quarter, text).alias("quarter_start"), F.date_format(F.date_sub(F.add_months(quarter, 3), 1), text).alias("quarter_end"),
        F.date_format(week, text).alias("week_start"), F.date_format(F.date_add(week, 6), text).alias("week_end"), F.date_format(F.last_day("day"), text).alias("month_end"),
        (((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)).alias("is_leap"), F.concat(year, F.lit(" Q"), F.quarter("day")).alias("label"))


@query("cal_consecutive_days", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(round(total, 4), 0) AS total FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM ({BOUNDS})) c
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS od, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000 GROUP BY 1) o ON o.od = c.day
""")
def cal_consecutive_days(spark, d):
    """A daily series without gaps."""
    orders = table(spark, d, "orders")
    bounds = orders.agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    days = bounds.select(F.explode(P.calendar(F.col("lo"), F.col("hi"))).alias("day"))
    counts = (orders.filter("o_orderstatus = 'P' AND o_totalprice > 200000").groupBy(F.to_date("o_orderdate").alias("day"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))
    return days.join(counts, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.round("total", 4), F.lit(0.0)).alias("total"))


@query("cal_diff_days", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS days, CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) AS later
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def cal_diff_days(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(orders, "l_orderkey")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").alias("days"), (F.to_date("l_shipdate") > F.to_date("o_orderdate")).alias("later"))


@query("cal_shift", """
SELECT event_id, strftime(ts + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year, strftime(ts + to_months(CAST(event_id % 14 AS INT)), '%Y-%m-%d %H:%M:%S') AS months,
       strftime(ts - to_days(CAST(event_id % 40 AS INT)), '%Y-%m-%d %H:%M:%S') AS days, strftime(ts + to_hours(CAST(event_id % 30 AS INT)) + INTERVAL 5 MINUTE - INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS clock,
       strftime(ts + to_milliseconds(1500), '%Y-%m-%d %H:%M:%S') AS millis FROM events
""")
def cal_shift(spark, d):
    text, n = "yyyy-MM-dd HH:mm:ss", F.col("event_id").cast("int")
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", F.date_format(ts + F.expr("interval 1 year"), "yyyy-MM-dd").alias("next_year"), F.date_format(ts + F.make_ym_interval(F.lit(0), n % 14), text).alias("months"),
        F.date_format(ts - F.make_dt_interval(days=n % 40), text).alias("days"),
        F.date_format(ts + F.make_dt_interval(hours=n % 30) + F.expr("interval 5 minutes") - F.expr("interval 30 seconds"), text).alias("clock"),
        F.date_format(ts + F.expr("interval 1500 milliseconds"), text).alias("millis"))


@query("cal_weekday_pick", "SELECT o_orderkey, strftime(date_trunc('week', o_orderdate) + to_days(CAST(o_orderkey % 7 AS INT)), '%Y-%m-%d') AS picked FROM orders")
def cal_weekday_pick(spark, d):
    n = (F.col("o_orderkey") % 7).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(F.date_add(P.week_start("o_orderdate"), n), "yyyy-MM-dd").alias("picked"))


@query("cal_make", """
SELECT o_orderkey, strftime(make_date(year(o_orderdate), month(o_orderdate), 1), '%Y-%m-%d') AS first_day,
       strftime(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 24, o_orderkey % 60, 0.0), '%Y-%m-%d %H:%M:%S') AS at,
       strftime(least(o_orderdate, TIMESTAMP '1998-01-01'), '%Y-%m-%d') AS earlier, strftime(greatest(o_orderdate, TIMESTAMP '1998-01-01'), '%Y-%m-%d') AS later,
       strftime(date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS day_end FROM orders
""")
def cal_make(spark, d):
    """The end of a day is its last millisecond."""
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    pivot = F.lit("1998-01-01").cast("timestamp_ntz")
    at = F.make_timestamp_ntz(F.year(date), F.month(date), F.day(date), (key % 24).cast("int"), (key % 60).cast("int"), F.lit(0))
    day_end = F.date_trunc("day", date) + F.expr("interval 1 day") - F.expr("interval 1 millisecond")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(F.make_date(F.year(date), F.month(date), F.lit(1)), "yyyy-MM-dd").alias("first_day"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.date_format(F.least(date, pivot), "yyyy-MM-dd").alias("earlier"), F.date_format(F.greatest(date, pivot), "yyyy-MM-dd").alias("later"),
        F.date_format(day_end, "yyyy-MM-dd HH:mm:ss.SSS").alias("day_end"))


@query("cal_time_of_day", """
SELECT event_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute_of_day, CAST(minute(ts) AS INT) AS elapsed, CAST(60 - minute(ts) AS INT) AS remaining FROM events
""")
def cal_time_of_day(spark, d):
    hour, minute = F.hour("ts"), F.minute("ts")
    return table(spark, d, "events").select("event_id", hour.alias("hour_of_day"), (hour * 60 + minute).alias("minute_of_day"), minute.alias("elapsed"), (60 - minute).alias("remaining"))


@query("num_format", """
SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS grouped, concat(printf('%.2f', round(100 * o_totalprice / 500000, 2)), '%') AS percent FROM orders
""")
def num_format(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.format_number(F.floor(price), 0).alias("grouped"), F.concat(F.format_string("%.2f", F.round(100 * price / 500000, 2)), F.lit("%")).alias("percent"))


@query("num_parse_default", """
SELECT p_partkey, coalesce(TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS INT), -1) AS parsed,
       regexp_matches(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END, '^[+-]?\\d+(\\.\\d+)?$') AS numeric FROM part
""")
def num_parse_default(spark, d):
    name = F.col("p_partkey") % 3 == 0
    text = F.when(name, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    price = F.when(name, F.col("p_name")).otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(text.try_cast("int"), F.lit(-1)).alias("parsed"), price.rlike(r"^[+-]?\d+(\.\d+)?$").alias("numeric"))


@query("num_radix", "SELECT o_orderkey, bin(o_orderkey) AS binary_text, hex(o_custkey) AS hex_text, hex(o_orderstatus) AS status_hex FROM orders")
def num_radix(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.bin("o_orderkey").alias("binary_text"), F.hex("o_custkey").alias("hex_text"), F.hex("o_orderstatus").alias("status_hex"))


@query("cat_current", f"""
SELECT c.table_name, c.column_name, n.n_rows, TRUE AS in_session, TRUE AS has_functions
FROM information_schema.columns c JOIN ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)}) n ON n.table_name = c.table_name
""")
def cat_current(spark, d):
    """All tables and columns as the session's catalog lists them, with their row counts, the current database and functions."""
    for name in TABLES:
        table(spark, d, name).createOrReplaceTempView(name)
    listed = {t.name for t in spark.catalog.listTables()}
    columns = [(t, c.name) for t in TABLES if t in listed for c in spark.catalog.listColumns(t)]
    counts = spark.sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
    known = len(spark.catalog.listFunctions(pattern="date_*")) > 0
    return spark.createDataFrame(columns, "table_name string, column_name string").join(counts, "table_name").withColumn(
        "in_session", F.current_database() == F.lit(spark.catalog.currentDatabase())).withColumn("has_functions", F.lit(known))
