"""Date and time functions."""
from pyspark.sql import functions as F

from tracewell.registry import query
from tracewell.sources import table

TEXT = "yyyy-MM-dd HH:mm:ss"


@query("fn_date_extract", """
SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(quarter(ts) AS INT) AS q, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS dd, CAST(day(ts) AS INT) AS dom, CAST(dayofyear(ts) AS INT) AS doy, CAST(dayofweek(ts) + 1 AS INT) AS dow,
       CAST(weekofyear(ts) AS INT) AS w, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s FROM events
""")
def fn_date_extract(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.year("ts").alias("y"), F.quarter("ts").alias("q"), F.month("ts").alias("m"), F.day("ts").alias("dd"), F.dayofmonth("ts").alias("dom"), F.dayofyear("ts").alias("doy"), F.dayofweek("ts").alias("dow"),
        F.weekofyear("ts").alias("w"), F.hour("ts").alias("h"), F.minute("ts").alias("mi"), F.second("ts").alias("s"))


@query("fn_date_arith", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 13 AS INT)), '%Y-%m-%d') AS months, CAST(date_diff('day', DATE '1998-01-31', CAST(o_orderdate AS DATE)) AS INT) AS days,
       strftime(o_orderdate + to_days(CAST(o_orderkey % 90 AS INT)), '%Y-%m-%d') AS plus, strftime(o_orderdate - to_days(CAST(o_orderkey % 90 AS INT)), '%Y-%m-%d') AS minus,
       round(CASE WHEN day(o_orderdate) = 31 OR last_day(o_orderdate) = CAST(o_orderdate AS DATE) THEN (year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 1
                  ELSE (year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 1 + (day(o_orderdate) - 31) / 31.0 END, 8) AS between_months FROM orders
""")
def fn_date_arith(spark, d):
    date, n = F.to_date("o_orderdate"), F.col("o_orderkey").cast("int")
    origin = F.lit("1998-01-31").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(F.add_months(date, n % 13), "yyyy-MM-dd").alias("months"), F.datediff(date, origin).alias("days"), F.date_format(F.date_add(date, n % 90), "yyyy-MM-dd").alias("plus"),
        F.date_format(F.date_sub(date, n % 90), "yyyy-MM-dd").alias("minus"), F.months_between(date, origin).alias("between_months"))


@query("fn_date_trunc", """
SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month_start, strftime(date_trunc('year', ts), '%Y-%m-%d') AS year_start, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start,
       strftime(date_trunc('quarter', ts), '%Y-%m-%d') AS quarter_start, strftime(last_day(ts), '%Y-%m-%d') AS month_end, strftime(date_trunc('week', ts) + INTERVAL 7 DAY, '%Y-%m-%d') AS next_monday FROM events
""")
def fn_date_trunc(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, d, "events").select(
        "event_id", day(F.trunc("ts", "MM")).alias("month_start"), day(F.trunc("ts", "YEAR")).alias("year_start"), F.date_format(F.date_trunc("hour", "ts"), TEXT).alias("hour_start"), day(F.date_trunc("week", "ts")).alias("week_start"),
        day(F.date_trunc("quarter", "ts")).alias("quarter_start"), day(F.last_day("ts")).alias("month_end"), day(F.next_day("ts", "MO")).alias("next_monday"))


@query("fn_date_format", """
SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS shown, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(epoch(ts)) AS BIGINT) AS secs, CAST(floor(epoch(ts)) AS BIGINT) AS secs2, strftime(ts, '%Y-%m-%d %H:%M:%S') AS back,
       strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS parsed, NULL::VARCHAR AS failed FROM events
""")
def fn_date_format(spark, d):
    text = F.date_format("ts", TEXT)
    shown = F.date_format("ts", "dd/MM/yyyy HH:mm")
    return table(spark, d, "events").select(
        "event_id", shown.alias("shown"), F.date_format(F.to_date(text, TEXT), "yyyy-MM-dd").alias("day"), F.unix_timestamp(text, TEXT).alias("secs"), F.to_unix_timestamp(text, F.lit(TEXT)).alias("secs2"),
        F.from_unixtime(F.unix_timestamp(text, TEXT), TEXT).alias("back"), F.date_format(F.to_timestamp(shown, "dd/MM/yyyy HH:mm"), TEXT).alias("parsed"),
        F.date_format(F.try_to_timestamp("event_type", F.lit(TEXT)), TEXT).alias("failed"))


@query("fn_date_now", "SELECT count(*) AS n, TRUE AS same_date, TRUE AS same_time FROM orders")
def fn_date_now(spark, d):
    """The clock stands still within a query."""
    rows = table(spark, d, "orders").select((F.current_date() == F.to_date(F.now())).alias("same_date"), (F.current_timestamp() == F.now()).alias("same_time"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and("same_date").alias("same_date"), F.bool_and("same_time").alias("same_time"))


@query("fn_tz", """
SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS new_york, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS from_shanghai FROM events
""")
def fn_tz(spark, d):
    """All events lie in January, so New York is five hours behind."""
    return table(spark, d, "events").select(
        "event_id", F.date_format(F.from_utc_timestamp("ts", "America/New_York"), TEXT).alias("new_york"), F.date_format(F.to_utc_timestamp("ts", "Asia/Shanghai"), TEXT).alias("from_shanghai"))
