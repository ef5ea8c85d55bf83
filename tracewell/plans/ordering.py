"""Sort, limit, sample and partitioning queries."""
from pyspark.sql import functions as F

from tracewell.operators.skew import numbered
from tracewell.registry import query
from tracewell.sources import run_sql, table
from tracewell.storage import keep, scratch_path


@query("srt_global", """
SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders
""")
def srt_global(spark, d):
    """A total order with its places; the sort itself is a range-partitioned ORDER BY."""
    orders = table(spark, d, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS status", "o_totalprice")
    placed = numbered(orders, [], ["-o_totalprice", "o_orderkey"])
    return placed.orderBy(F.desc("o_totalprice"), "o_orderkey").select(F.col("rn").alias("place"), "o_orderkey", "status")


@query("srt_nulls", """
SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey % 50 ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST, c_custkey) AS INT) AS last_place,
       CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey % 50 ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS FIRST, c_custkey) AS INT) AS first_place FROM customer
""")
def srt_nulls(spark, d):
    """Null placement in ascending and descending order, shown by places in small groups."""
    from pyspark.sql import Window as W
    part = W.partitionBy("c_nationkey", F.col("c_custkey") % 50)
    df = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", "nullif(c_mktsegment, 'BUILDING') AS segment")
    return df.select("c_custkey", "segment", F.row_number().over(part.orderBy(F.asc_nulls_last("segment"), "c_custkey")).alias("last_place"),
                     F.row_number().over(part.orderBy(F.desc_nulls_first("segment"), "c_custkey")).alias("first_place"))


@query("srt_local", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def srt_local(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").sortWithinPartitions(F.desc("l_quantity"))


@query("srt_distribute", "SELECT o_orderkey, o_custkey FROM orders")
def srt_distribute(spark, d):
    return run_sql(spark, d, "SELECT o_orderkey, o_custkey FROM orders DISTRIBUTE BY o_custkey, o_orderkey SORT BY o_custkey DESC", "orders")


@query("srt_cluster", "SELECT o_custkey, o_orderkey FROM orders")
def srt_cluster(spark, d):
    return run_sql(spark, d, "SELECT o_custkey, o_orderkey FROM orders CLUSTER BY o_custkey, o_orderkey", "orders")


@query("lim_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def lim_limit(spark, d):
    return run_sql(spark, d, "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25) LIMIT ALL", "orders")


@query("lim_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def lim_topk(spark, d):
    return (table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
            .orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20))


def _sample_facts(sample, whole, share, keys, **facts):
    """How a sample relates to its table: size within six deviations of the share asked for, nothing foreign in it."""
    total = whole.agg(F.count(F.lit(1)).alias("n_rows"))
    picked = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).join(whole.withColumn("here", F.lit(True)), keys, "left")
    found = picked.agg(F.sum("c").alias("n"), F.coalesce(F.every(F.coalesce("here", F.lit(False))), F.lit(True)).alias("subset"), F.bit_xor(F.xxhash64(*keys, "c")).alias("print"))
    spread = 6 * F.sqrt(F.col("n_rows") * share * (1 - share)) + 1
    return total.crossJoin(F.broadcast(found)).select("n_rows", (F.abs(F.coalesce("n", F.lit(0)) - F.col("n_rows") * share) <= spread).alias("within"), "subset", "print", *[F.lit(v).alias(k) for k, v in facts.items()])


def _checked_sample(draw, whole, share, keys, **facts):
    """A sample drawn twice: the same rows must come."""
    one, two = (_sample_facts(draw(), whole, share, keys, **facts) for _ in range(2))
    again = two.select(F.col("print").alias("again"))
    return one.crossJoin(F.broadcast(again)).withColumn("repeatable", F.col("print").eqNullSafe(F.col("again"))).drop("print", "again")


SAMPLE_OK = "SELECT '{kind}' AS kind, count(*) AS n_rows, TRUE AS within, TRUE AS subset, TRUE AS repeatable FROM {table}"


@query("smp_percent", SAMPLE_OK.format(kind="without", table="lineitem") + " UNION ALL " + SAMPLE_OK.format(kind="with", table="lineitem"))
def smp_percent(spark, d):
    """One sample without and one with replacement: size, membership, and the same rows when drawn again."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    df = table(spark, d, "lineitem").select(*keys)
    whole = df.distinct()
    text = f"SELECT {', '.join(keys)} FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)"
    plain = _checked_sample(lambda: run_sql(spark, d, text, "lineitem"), whole, 0.1, keys, kind="without")
    return plain.unionByName(_checked_sample(lambda: df.sample(True, 0.1, 7), whole, 0.1, keys, kind="with"))


@query("smp_bucket", "SELECT count(*) AS n_rows, TRUE AS each_once, TRUE AS even FROM orders")
def smp_bucket(spark, d):
    """Buckets by key hash, samples that stay the same in every run: all eight hold every row once, none is far from an eighth."""
    placed = table(spark, d, "orders").select(F.pmod(F.hash("o_orderkey"), F.lit(8)).alias("bucket"), "o_orderkey")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"))
    return sizes.agg(F.sum("n").alias("n_rows"), (F.sum("n") == F.sum("keys")).alias("each_once"),
                     (F.max(F.abs(F.col("n") - 0)) <= F.sum("n") / 8 + 6 * F.sqrt(F.sum("n") * 7 / 64) + 1).alias("even"))


@query("smp_bucket_fraction", SAMPLE_OK.format(kind="bucket", table="orders").replace(", TRUE AS repeatable", ""))
def smp_bucket_fraction(spark, d):
    """BUCKET x OUT OF y draws that share of the rows."""
    whole = table(spark, d, "orders").select("o_orderkey")
    sample = run_sql(spark, d, "SELECT o_orderkey FROM orders TABLESAMPLE (BUCKET 3 OUT OF 8)", "orders")
    return _sample_facts(sample, whole, 3 / 8, ["o_orderkey"], kind="bucket").drop("print")


@query("smp_rows", "SELECT least(count(*), 40) AS n, TRUE AS subset FROM orders")
def smp_rows(spark, d):
    """The first rows as they come, as many as asked for."""
    sample = run_sql(spark, d, "SELECT o_orderkey FROM orders TABLESAMPLE (40 ROWS)", "orders")
    known = table(spark, d, "orders").select("o_orderkey", F.lit(True).alias("here"))
    return sample.join(known, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("here", F.lit(False))).alias("subset"))


def partitions(spark) -> int:
    """How many partitions this session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("prt_repartition", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def prt_repartition(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(partitions(spark), "l_orderkey", "l_partkey")


@query("prt_coalesce", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem")
def prt_coalesce(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").repartition(4 * partitions(spark), "l_orderkey").coalesce(partitions(spark))


@query("prt_range", "SELECT o_orderkey, o_totalprice FROM orders")
def prt_range(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(partitions(spark), F.col("o_totalprice").desc(), "o_orderkey")


def bucketed(df, key, label):
    """Writes a frame as a table bucketed and sorted by a key; gives the table's name, its files stay when it is dropped."""
    path = scratch_path(df.sparkSession, label)
    name = f"{label}_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(partitions(df.sparkSession), key).sortBy(key).option("path", path).saveAsTable(name)
    return name


@query("prt_bucketed_write", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def prt_bucketed_write(spark, d):
    """Bucketed and sorted by order key; joins on it need no shuffle afterwards."""
    return spark.table(bucketed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", "bucketed"))


def order_totals(spark, orders, lines):
    """Quantity per order with lines, from two tables bucketed alike: joined and summed bucket by bucket."""
    parts = spark.table(lines).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    both = spark.table(orders).hint("merge").join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", "o_orderpriority", "n_lines", "qty")


@query("prt_bucketed_join", """
SELECT o_orderkey, o_orderpriority, count(*) AS n_lines, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
""")
def prt_bucketed_join(spark, d):
    """Both sides written once by order key; the join and the sums shuffle nothing. The tables leave the catalog again."""
    orders = bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "orders_by_key")
    lines = bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", "lines_by_key")
    out = keep(order_totals(spark, orders, lines))
    for name in (orders, lines):
        spark.sql(f"DROP TABLE {name}")
    return out
