"""Join queries.

Fact sides are reduced before a shuffle where the result allows it; what is left
of a hot key is split at run time by adaptive execution.
"""
import pandas as pd
from pyspark.sql import functions as F

from tracewell.operators.joins import broadcast_if_small, interval_join, range_join
from tracewell.registry import query
from tracewell.sources import run_sql, table

PER_CUSTOMER = "(SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top FROM orders GROUP BY 1)"


def per_customer(spark, d):
    """Orders reduced to one row per customer before any join."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top"))


@query("join_inner", """
SELECT l_orderkey, l_linenumber, o_orderpriority, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
""")
def join_inner(spark, d):
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_totalprice")
    return lines.join(orders, "l_orderkey")


@query("join_left", f"SELECT c_custkey, n_orders, top FROM customer LEFT JOIN {PER_CUSTOMER} p ON p.o_custkey = c_custkey AND c_acctbal > 0")
def join_left(spark, d):
    customers, orders = table(spark, d, "customer"), per_customer(spark, d)
    return customers.join(orders, (F.col("custkey") == F.col("c_custkey")) & (F.col("c_acctbal") > 0), "left").select("c_custkey", "n_orders", "top")


@query("join_right", f"SELECT c_name, o_custkey AS custkey, n_orders FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN {PER_CUSTOMER} p ON p.o_custkey = c_custkey")
def join_right(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 5000")
    return rich.join(per_customer(spark, d), F.col("custkey") == F.col("c_custkey"), "right").select("c_name", "custkey", "n_orders")


@query("join_full", f"""
SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, n_orders FROM (SELECT * FROM customer WHERE c_nationkey < 12) c
FULL JOIN (SELECT * FROM {PER_CUSTOMER} WHERE top > 300000) p ON p.o_custkey = c_custkey
""")
def join_full(spark, d):
    some = table(spark, d, "customer").filter("c_nationkey < 12")
    big = per_customer(spark, d).filter("top > 300000")
    return some.join(big, F.col("custkey") == F.col("c_custkey"), "full").select(F.coalesce("c_custkey", "custkey").alias("custkey"), "c_name", "n_orders")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_semi(spark, d):
    buyers = table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, d, "customer").join(buyers, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_anti(spark, d):
    buyers = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, d, "customer").join(buyers, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("join_cross", "SELECT s_suppkey, round(s_acctbal / total, 9) AS share FROM supplier CROSS JOIN (SELECT sum(s_acctbal) AS total FROM supplier) t")
def join_cross(spark, d):
    """The other side is one row, the grand total."""
    suppliers = table(spark, d, "supplier")
    total = suppliers.agg(F.sum("s_acctbal").alias("total"))
    return suppliers.crossJoin(total).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("total"), 9).alias("share"))


@query("join_existence", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) AS has_discount FROM orders")
def join_existence(spark, d):
    return run_sql(spark, d, """
        SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) AS has_discount FROM orders
    """, "orders", "lineitem")


@query("join_using", "SELECT nationkey, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY 1) c JOIN (SELECT s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY 1) s USING (nationkey)")
def join_using(spark, d):
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return customers.join(suppliers, ["nationkey"])


@query("join_natural", """
SELECT regionkey, r_name, nationkey, n_name FROM (SELECT r_regionkey AS regionkey, r_name FROM region) r
NATURAL JOIN (SELECT n_regionkey AS regionkey, n_nationkey AS nationkey, n_name FROM nation) n
NATURAL JOIN (SELECT DISTINCT c_nationkey AS nationkey FROM customer) c
""")
def join_natural(spark, d):
    return run_sql(spark, d, """
        SELECT regionkey, r_name, nationkey, n_name FROM (SELECT r_regionkey AS regionkey, r_name FROM region) r
        NATURAL JOIN (SELECT n_regionkey AS regionkey, n_nationkey AS nationkey, n_name FROM nation) n
        NATURAL JOIN (SELECT DISTINCT c_nationkey AS nationkey FROM customer) c
    """, "region", "nation", "customer")


@query("join_theta", """
SELECT c_custkey, b.band FROM customer JOIN (SELECT n_nationkey AS band, n_nationkey * 450.0 - 1000 AS lo, (n_nationkey + 1) * 450.0 - 1000 AS hi FROM nation) b
ON c_acctbal >= b.lo AND c_acctbal < b.hi
""")
def join_theta(spark, d):
    """Balance bands: one band row per nation, met on steps of a band's width."""
    bands = table(spark, d, "nation").selectExpr("n_nationkey AS band", "n_nationkey * 450.0D - 1000 AS lo", "(n_nationkey + 1) * 450.0D - 1000 AS hi")
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return range_join(customers, bands, "c_acctbal", "lo", "hi", width=450.0).select("c_custkey", "band")


@query("join_range", """
SELECT s.s_suppkey, p.p_partkey FROM supplier s CROSS JOIN (SELECT 10000.0 / count(*) AS width FROM part) w
JOIN part p ON p.p_retailprice >= s.s_acctbal / 5 AND p.p_retailprice < s.s_acctbal / 5 + w.width
""")
def join_range(spark, d):
    """The parts in a supplier's price range, which is narrower the more parts there are: pairs grow as the suppliers do."""
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    width = 10000.0 / max(1, parts.count())
    offers = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 5).alias("lo"), (F.col("s_acctbal") / 5 + width).alias("hi"))
    return range_join(parts, offers, "p_retailprice", "lo", "hi", width=width).select("s_suppkey", "p_partkey")


@query("join_interval", """
SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 30 MINUTE
WHERE c.event_type = 'click' AND p.event_type = 'purchase'
""")
def join_interval(spark, d):
    events = table(spark, d, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    purchases = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id"))
    return interval_join(clicks, purchases, ["user_id"], "click_ts", "purchase_ts", minutes=30).select("click_id", "purchase_id")


@query("join_nullsafe", """
SELECT a.flag, a.n AS n_lines, b.n AS n_status FROM (SELECT nullif(l_returnflag, 'N') AS flag, count(*) AS n FROM lineitem GROUP BY 1) a
JOIN (SELECT nullif(nullif(o_orderstatus, 'O'), 'P') AS flag, count(*) AS n FROM orders GROUP BY 1) b ON a.flag IS NOT DISTINCT FROM b.flag
""")
def join_nullsafe(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.expr("nullif(l_returnflag, 'N')").alias("flag")).agg(F.count(F.lit(1)).alias("n_lines"))
    b = table(spark, d, "orders").groupBy(F.expr("nullif(nullif(o_orderstatus, 'O'), 'P')").alias("b_flag")).agg(F.count(F.lit(1)).alias("n_status"))
    return a.join(b, a["flag"].eqNullSafe(b["b_flag"])).select("flag", "n_lines", "n_status")


@query("join_self", """
SELECT a.conv_id, a.turn, b.role AS answered_by FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
""")
def join_self(spark, d):
    """Every turn with the role of the next one."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    a, b = turns.alias("a"), turns.alias("b")
    return a.join(b, (F.col("b.conv_id") == F.col("a.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select(
        F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("b.role").alias("answered_by"))


@query("join_nested_relation", """
SELECT c_custkey, n_name, r_name, top FROM customer JOIN (nation CROSS JOIN (SELECT r_regionkey, r_name, (SELECT max(o_totalprice) FROM orders) AS top FROM region) r) ON c_nationkey = n_nationkey AND n_regionkey = r_regionkey
""")
def join_nested_relation(spark, d):
    """A joined pair of relations as the right side; the inner product pairs each nation with the grand maximum."""
    top = table(spark, d, "orders").agg(F.max("o_totalprice").alias("top"))
    inner = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(top)
    return table(spark, d, "customer").join(inner, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name", "top")


@query("join_multiway", """
SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY ALL
""")
def join_multiway(spark, d):
    """Lines are summed per order, orders per customer, before the next join widens them."""
    line_totals = (table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
                   .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))
    recent = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    per_cust = recent.join(line_totals, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("n"), F.sum("revenue").alias("revenue"))
    per_nation = (table(spark, d, "customer").select("c_custkey", "c_nationkey").join(per_cust, "c_custkey")
                  .groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("n_lines"), F.sum("revenue").alias("revenue")))
    return (per_nation.join(table(spark, d, "nation"), "n_nationkey").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
            .select("r_name", "n_name", "n_lines", F.round("revenue", 4).alias("revenue")))


@query("join_broadcast_hint", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def join_broadcast_hint(spark, d):
    nations = broadcast_if_small(table(spark, d, "nation").select("n_nationkey", "n_name"))
    return table(spark, d, "supplier").join(nations, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")


@query("join_cogroup", """
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS n_clicks, coalesce(b.n, 0) AS n_purchases
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL) a
FULL JOIN (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.day = b.day
""")
def join_cogroup(spark, d):
    """Both sides' groups of a user in one function; a group holds one counted row per day."""
    def side(kind):
        daily = table(spark, d, "events").filter(F.col("event_type") == kind).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
        return daily.agg(F.count(F.lit(1)).alias("n")).groupBy("user_id")

    def compare(key, clicks: pd.DataFrame, purchases: pd.DataFrame) -> pd.DataFrame:
        a, b = dict(zip(clicks["day"], clicks["n"])), dict(zip(purchases["day"], purchases["n"]))
        days = sorted(a.keys() | b.keys())
        return pd.DataFrame({"user_id": [key[0]] * len(days), "day": days, "n_clicks": [int(a.get(x, 0)) for x in days], "n_purchases": [int(b.get(x, 0)) for x in days]})

    return side("click").cogroup(side("purchase")).applyInPandas(compare, "user_id long, day string, n_clicks long, n_purchases long")
