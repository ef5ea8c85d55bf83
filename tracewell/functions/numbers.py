"""Null handling, conditions and number functions."""
import hashlib
import zlib

import pandas as pd
from pyspark.sql import functions as F

from tracewell.registry import query
from tracewell.sources import table


@query("fn_null", """
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(l_tax, 0), l_discount) AS first_value, greatest(nullif(l_tax, 0), l_discount) AS high, least(nullif(l_tax, 0), l_discount) AS low,
       l_discount = 0 AS not_a_number, CASE WHEN l_discount = 0 THEN -1 ELSE l_discount END AS number_or, ifnull(nullif(l_tax, 0), 9) AS filled, nullif(l_tax, 0) IS NULL AS missing,
       nullif(l_tax, 0) IS NOT NULL AS there, CASE WHEN l_tax <> 0 THEN 'yes' ELSE 'no' END AS told, coalesce(nullif(l_tax, 0), 7) AS filled2 FROM lineitem
""")
def fn_null(spark, d):
    tax = F.nullif("l_tax", F.lit(0.0))
    nan = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.coalesce(tax, "l_discount").alias("first_value"), F.greatest(tax, "l_discount").alias("high"), F.least(tax, "l_discount").alias("low"),
        F.isnan(nan).alias("not_a_number"), F.nanvl(nan, F.lit(-1.0)).alias("number_or"), F.ifnull(tax, F.lit(9.0)).alias("filled"), F.isnull(tax).alias("missing"),
        F.isnotnull(tax).alias("there"), F.nvl2(tax, F.lit("yes"), F.lit("no")).alias("told"), F.nvl(tax, F.lit(7.0)).alias("filled2"))


@query("fn_cond", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, CASE WHEN c_nationkey > 12 THEN 1 ELSE 0 END AS late,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS short FROM customer
""")
def fn_cond(spark, d):
    balance = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.when(balance < 0, "debt").when(balance < 5000, "low").otherwise("high").alias("band"), F.expr("if(c_nationkey > 12, 1, 0)").alias("late"),
        F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END").alias("short"))


@query("fn_math_arith", """
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey + l_suppkey AS plus, l_suppkey - l_partkey AS minus, l_partkey * l_linenumber AS times, round(l_extendedprice / l_quantity, 8) AS ratio,
       (l_suppkey - l_partkey) % 7 AS rest, (((l_suppkey - l_partkey) % 7) + 7) % 7 AS pos_rest, abs(l_suppkey - l_partkey) AS distance, -l_quantity AS negated, l_quantity AS kept,
       CAST(sign(l_suppkey - l_partkey) AS DOUBLE) AS direction, l_partkey % nullif(l_linenumber - 1, 0) AS rest_or_null, l_quantity / nullif(l_tax, 0) IS NULL AS undefined, l_partkey // l_linenumber AS whole FROM lineitem
""")
def fn_math_arith(spark, d):
    gap = F.col("l_suppkey") - F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") + F.col("l_suppkey")).alias("plus"), gap.alias("minus"), (F.col("l_partkey") * F.col("l_linenumber")).alias("times"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8).alias("ratio"), F.expr("mod(l_suppkey - l_partkey, 7)").alias("rest"), F.pmod(gap, F.lit(7)).alias("pos_rest"),
        F.abs(gap).alias("distance"), F.negative("l_quantity").alias("negated"), F.positive("l_quantity").alias("kept"), F.signum(gap).alias("direction"),
        F.try_mod("l_partkey", F.col("l_linenumber") - 1).alias("rest_or_null"), F.isnull(F.try_divide("l_quantity", F.col("l_tax"))).alias("undefined"), F.expr("l_partkey DIV l_linenumber").alias("whole"))


@query("fn_math_round", """
SELECT s_suppkey, round(s_acctbal, 1) AS one, round(s_acctbal, -2) AS hundreds, round_even(s_acctbal, 0) AS even, CAST(ceil(s_acctbal) AS BIGINT) AS up, CAST(floor(s_acctbal) AS BIGINT) AS down,
       CAST(ceiling(s_acctbal / 7) AS BIGINT) AS up7, round_even(s_acctbal / 3, 0) AS nearest FROM supplier
""")
def fn_math_round(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.round(b, 1).alias("one"), F.round(b, -2).alias("hundreds"), F.bround(b, 0).alias("even"), F.ceil(b).alias("up"), F.floor(b).alias("down"),
        F.ceiling(b / 7).alias("up7"), F.rint(b / 3).alias("nearest"))


@query("fn_math_log", """
SELECT p_partkey, round(ln(p_retailprice), 9) AS ln_p, round(log10(p_retailprice), 9) AS log10_p, round(log2(p_retailprice), 9) AS log2_p, round(ln(1 + p_size), 9) AS log1p_s, round(ln(p_retailprice) / ln(3), 9) AS log3_p,
       round(exp(p_size / 10.0), 9) AS exp_s, round(exp(p_size / 100.0) - 1, 9) AS expm1_s, round(sqrt(p_retailprice), 9) AS sqrt_p, round(cbrt(p_retailprice), 9) AS cbrt_p, round(pow(p_size, 1.5), 9) AS pow_s,
       round(power(p_size, 2), 9) AS square_s, CASE WHEN p_size <= 20 THEN CAST(factorial(p_size) AS BIGINT) END AS fact, round(exp(1) * p_size, 9) AS e_times FROM part
""")
def fn_math_log(spark, d):
    price, size = F.col("p_retailprice"), F.col("p_size")
    r = lambda c: F.round(c, 9)
    return table(spark, d, "part").select(
        "p_partkey", r(F.ln(price)).alias("ln_p"), r(F.log10(price)).alias("log10_p"), r(F.log2(price)).alias("log2_p"), r(F.log1p(size)).alias("log1p_s"), r(F.log(3.0, price)).alias("log3_p"),
        r(F.exp(size / 10.0)).alias("exp_s"), r(F.expm1(size / 100.0)).alias("expm1_s"), r(F.sqrt(price)).alias("sqrt_p"), r(F.cbrt(price)).alias("cbrt_p"), r(F.pow(size, 1.5)).alias("pow_s"),
        r(F.power(size, 2)).alias("square_s"), F.factorial(size).alias("fact"), r(F.e() * size).alias("e_times"))


@query("fn_math_trig", """
SELECT p_partkey, round(sin(a), 9) AS sin_a, round(cos(a), 9) AS cos_a, round(tan(a), 9) AS tan_a, round(cot(a), 9) AS cot_a, round(asin(u), 9) AS asin_u, round(acos(u), 9) AS acos_u, round(atan(a), 9) AS atan_a,
       round(atan2(a, u), 9) AS atan2_au, round(sinh(u), 9) AS sinh_u, round(cosh(u), 9) AS cosh_u, round(tanh(u), 9) AS tanh_u, round(degrees(a), 8) AS deg, round(radians(p_size), 9) AS rad,
       round(sqrt(a * a + u * u), 9) AS hyp, round(pi() * a, 9) AS pi_a FROM (SELECT p_partkey, p_size, p_size / 20.0 AS a, p_size / 60.0 AS u FROM part)
""")
def fn_math_trig(spark, d):
    a, u = F.col("p_size") / 20.0, F.col("p_size") / 60.0
    r = lambda c: F.round(c, 9)
    return table(spark, d, "part").select(
        "p_partkey", r(F.sin(a)).alias("sin_a"), r(F.cos(a)).alias("cos_a"), r(F.tan(a)).alias("tan_a"), r(F.cot(a)).alias("cot_a"), r(F.asin(u)).alias("asin_u"), r(F.acos(u)).alias("acos_u"),
        r(F.atan(a)).alias("atan_a"), r(F.atan2(a, u)).alias("atan2_au"), r(F.sinh(u)).alias("sinh_u"), r(F.cosh(u)).alias("cosh_u"), r(F.tanh(u)).alias("tanh_u"),
        F.round(F.degrees(a), 8).alias("deg"), r(F.radians("p_size")).alias("rad"), r(F.hypot(a, u)).alias("hyp"), r(F.pi() * a).alias("pi_a"))


@query("fn_math_bits", """
SELECT o_orderkey, o_orderkey & o_custkey AS both, o_orderkey | o_custkey AS either, xor(o_orderkey, o_custkey) AS one_of, ~o_orderkey AS inverted, o_orderkey << 3 AS up, o_orderkey >> 2 AS down, o_orderkey >> 1 AS down_unsigned FROM orders
""")
def fn_math_bits(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", key.bitwiseAND(cust).alias("both"), key.bitwiseOR(cust).alias("either"), key.bitwiseXOR(cust).alias("one_of"), F.bitwise_not(key).alias("inverted"),
        F.shiftleft(key, 3).alias("up"), F.shiftright(key, 2).alias("down"), F.shiftrightunsigned(key, 1).alias("down_unsigned"))


@query("fn_math_radix", """
SELECT o_orderkey, bin(o_orderkey) AS in_binary, hex(o_orderkey) AS in_hex, hex(o_custkey) AS rebased, bin(o_custkey) AS rebased2, o_orderstatus AS back FROM orders
""")
def fn_math_radix(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.bin("o_orderkey").alias("in_binary"), F.hex("o_orderkey").alias("in_hex"), F.conv(F.col("o_custkey").cast("string"), 10, 16).alias("rebased"),
        F.conv(F.col("o_custkey").cast("string"), 10, 2).alias("rebased2"), F.decode(F.unhex(F.hex("o_orderstatus")), "UTF-8").alias("back"))


@query("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s, sha1(c_mktsegment) AS s1, sha256(c_name) AS s256 FROM customer")
def fn_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha("c_name").alias("s"), F.sha1("c_mktsegment").alias("s1"), F.sha2("c_name", 256).alias("s256"))


@query("fn_hash_other", "SELECT c_custkey, TRUE AS crc_ok, TRUE AS s512_ok, TRUE AS spread_ok FROM customer")
def fn_hash_other(spark, d):
    """Checksums against the ones of another library, row by row; the hash must not be the same for all."""
    @F.pandas_udf("crc long, s512 string")
    def other(names: pd.Series) -> pd.DataFrame:
        raw = names.str.encode("utf-8")
        return pd.DataFrame({"crc": raw.map(zlib.crc32), "s512": raw.map(lambda b: hashlib.sha512(b).hexdigest())})

    rows = table(spark, d, "customer").select(
        "c_custkey", F.crc32(F.encode("c_name", "utf-8")).alias("crc"), F.sha2("c_name", 512).alias("s512"), F.hash("c_name", "c_nationkey").alias("h"), other("c_name").alias("o"))
    spread = table(spark, d, "customer").agg((F.approx_count_distinct(F.hash("c_name", "c_nationkey")) > 1).alias("spread_ok"))
    return rows.crossJoin(F.broadcast(spread)).select("c_custkey", (F.col("crc") == F.col("o.crc")).alias("crc_ok"), (F.col("s512") == F.col("o.s512")).alias("s512_ok"), "spread_ok")


@query("fn_id", "SELECT count(*) AS n, TRUE AS ids_unique, TRUE AS uuids_unique, TRUE AS uniform_ok, TRUE AS normal_ok, TRUE AS partitions_ok FROM lineitem")
def fn_id(spark, d):
    """Row ids and random columns: unique, and inside the ranges they promise."""
    rows = table(spark, d, "lineitem").select(
        F.monotonically_increasing_id().alias("id"), F.uuid().alias("u"), F.rand(1).alias("r"), F.randn(2).alias("g"), F.spark_partition_id().alias("p"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("id") == F.count("id")).alias("ids_unique"), (F.count_distinct("u") == F.count("u")).alias("uuids_unique"),
        ((F.min("r") >= 0) & (F.max("r") < 1)).alias("uniform_ok"), (F.abs(F.avg("g")) < 0.1).alias("normal_ok"), (F.min("p") >= 0).alias("partitions_ok"))


@query("fn_reflect", "SELECT o_orderkey, lower(hex(o_custkey)) AS hexed, bin(o_custkey) AS binary FROM orders")
def fn_reflect(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.reflect(F.lit("java.lang.Long"), F.lit("toHexString"), F.col("o_custkey")).alias("hexed"),
        F.java_method(F.lit("java.lang.Long"), F.lit("toBinaryString"), F.col("o_custkey")).alias("binary"))
