"""Source and sink queries. Sinks write whole tables to the shared folder and read them back."""
from pyspark.sql import functions as F

from tracewell.registry import query
from tracewell.sources import fixture, run_sql, table, use_all_cores
from tracewell.sources.files import CODECS, insert_static_partition, read_back, save_mode_result, whole_files, write_new
from tracewell.storage import scratch_path

from .column_lineage import NAMED, job_column_edges


@query("src_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def src_parquet(spark, d):
    return table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


FOLDER_FILES = 10_000  # that the driver lists at a time


@query("src_script_files", "SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages")
def src_script_files(spark, d):
    """Every page is written as a file of its own; the files are read back whole.

    The driver lists every file that is read, so pages are dealt over folders of about ``FOLDER_FILES``, which are
    written and read one after the other.
    """
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("value"))
    folders = max(1, -(-pages.count() // FOLDER_FILES))
    dealt = pages.withColumn("folder", F.pmod(F.monotonically_increasing_id(), F.lit(folders)))
    dealt = read_back(spark, write_new(dealt, "pages", partition_by=("folder",)), dealt)
    text = F.replace(F.col("content"), F.lit("\u0000"), F.lit(""))
    page_id = F.regexp_extract("path", r"page_id=(-?\d+)/", 1)
    out = scratch_path(spark, "script_files")
    for folder in range(folders):
        own = use_all_cores(dealt.filter(F.col("folder") == folder).drop("folder"))
        files = whole_files(spark, write_new(own, "files", "text", ("page_id",), lineSep="\u0000", maxRecordsPerFile=1))
        rows = files.select(F.when(page_id != "", page_id.cast("bigint")).alias("page_id"), F.length(text).cast("bigint").alias("n_chars"), F.md5(F.encode(text, "utf-8")).alias("digest"))
        rows.write.mode("append").parquet(out)
    return read_back(spark, out, rows)


@query("src_text_lines", """
SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents
""")
def src_text_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("src_json_lines", """
SELECT 'PERMISSIVE' AS mode, CASE WHEN value >= 5 THEN event_id END AS event_id, CASE WHEN value >= 5 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, CASE WHEN value < 5 THEN event_id END AS broken FROM events
UNION ALL SELECT 'DROPMALFORMED', event_id, CAST(json_extract_string(props, '$.k') AS INT), NULL FROM events WHERE value >= 5
UNION ALL SELECT 'FAILFAST', event_id, CAST(json_extract_string(props, '$.k') AS INT), NULL FROM events WHERE value >= 5
""")
def src_json_lines(spark, d):
    """JSON lines with comments and single quotes; low values come out as cut-off lines."""
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit("{'event_id': "), "event_id", F.lit(", /* key */ 'k': "), k, F.lit("}"))
    bad = F.concat(F.lit("{'broken_id': "), "event_id", F.lit(", "))
    events = table(spark, d, "events")
    mixed = write_new(events.select(F.when(F.col("value") >= 5, good).otherwise(bad).alias("value")), "json", "text")
    clean = write_new(events.filter("value >= 5").select(good.alias("value")), "json", "text")
    read = spark.read.option("allowSingleQuotes", True).option("allowComments", True)
    fields = "event_id bigint, k int"
    corrupt = F.regexp_extract("_corrupt_record", r"broken_id': (\d+)", 1)
    permissive = read.schema(fields + ", _corrupt_record string").json(mixed, mode="PERMISSIVE").select(
        F.lit("PERMISSIVE").alias("mode"), "event_id", "k", F.when(corrupt != "", corrupt.cast("bigint")).alias("broken"))
    out = permissive
    for mode, path in (("DROPMALFORMED", mixed), ("FAILFAST", clean)):
        rows = read.schema(fields).json(path, mode=mode)
        out = out.unionByName(rows.select(F.lit(mode).alias("mode"), "event_id", "k", F.lit(None).cast("bigint").alias("broken")))
    return out


@query("src_range", """
SELECT r.range AS o_orderkey FROM range((SELECT max(o_orderkey) + 1 FROM orders)) r WHERE r.range NOT IN (SELECT l_orderkey FROM lineitem)
""")
def src_range(spark, d):
    """The whole key range, left over where no line has the key."""
    top = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return spark.sql(f"SELECT id FROM range(0, {top + 1}, 1, 8)").join(used, "id", "left_anti").select(F.col("id").alias("o_orderkey"))


VALUES = "SELECT o_orderkey, t.weight FROM orders JOIN (VALUES ('1-URGENT', 10), ('2-HIGH', 5), ('5-LOW', 1)) AS t(name, weight) ON t.name = o_orderpriority"


@query("src_inline_values", VALUES)
def src_inline_values(spark, d):
    return run_sql(spark, d, VALUES, "orders")


ONE_ROW = "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT max(l_quantity) FROM lineitem) AS top, concat('a', 'b') AS word"


@query("src_one_row", ONE_ROW)
def src_one_row(spark, d):
    return run_sql(spark, d, ONE_ROW, "orders", "lineitem")


@query("src_local_relation", "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS meaning, count(*) AS n FROM lineitem GROUP BY 1")
def src_local_relation(spark, d):
    names = spark.createDataFrame([("A", "accepted"), ("R", "returned"), ("N", "none")], "l_returnflag string, meaning string")
    counts = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names, "l_returnflag").select("meaning", "n")


@query("src_file_meta", "SELECT 'lineitem.parquet' AS file_name, TRUE AS inside, TRUE AS has_length, count(*) AS n FROM lineitem")
def src_file_meta(spark, d):
    """Per source file: rows, and whether every block has a place and a length."""
    return (table(spark, d, "lineitem").select(
                F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.input_file_block_start().alias("start"),
                F.input_file_block_length().alias("length"))
            .groupBy("file_name").agg(F.bool_and(F.col("start") >= 0).alias("inside"), F.bool_and(F.col("length") > 0).alias("has_length"), F.count(F.lit(1)).alias("n")))


@query("src_view", "SELECT segment, count(*) AS n FROM (SELECT c_mktsegment AS segment FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def src_view(spark, d):
    table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("segment")).createOrReplaceTempView("solvent_customers")
    return spark.sql("SELECT segment, count(*) AS n FROM solvent_customers GROUP BY segment")


ORDER_ROWS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def order_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("snk_insert_append", ORDER_ROWS)
def snk_insert_append(spark, d):
    rows = order_rows(spark, d)
    path = write_new(rows.filter("o_orderstatus = 'F'"), "append")
    rows.filter("o_orderstatus <> 'F'").write.mode("append").parquet(path)
    return read_back(spark, path, rows)


@query("snk_insert_overwrite", ORDER_ROWS + " WHERE o_totalprice > 100000")
def snk_insert_overwrite(spark, d):
    rows = order_rows(spark, d)
    path = write_new(rows, "overwrite")
    rows.filter("o_totalprice > 100000").write.mode("overwrite").parquet(path)
    return read_back(spark, path, rows)


@query("snk_partition_static", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def snk_partition_static(spark, d):
    """Two static partitions; a second insert with IF NOT EXISTS leaves the first alone."""
    path = scratch_path(spark, "static")
    rows = order_rows(spark, d)

    def part(status):
        return rows.filter(F.col("o_orderstatus") == status).drop("o_orderstatus")

    insert_static_partition(part("F"), path, "o_orderstatus", "F")
    insert_static_partition(part("O"), path, "o_orderstatus", "O")
    insert_static_partition(part("P"), path, "o_orderstatus", "F", if_not_exists=True)
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path)


@query("snk_partition_dynamic", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus, CAST(year(o_orderdate) AS INT) AS y FROM orders
""")
def snk_partition_dynamic(spark, d):
    """Only the partitions met in the second write are replaced."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("y"))
    path = write_new(rows, "dynamic", partition_by=("o_orderstatus", "y"))
    changed = rows.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0))
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus", "y").parquet(path)
    return read_back(spark, path, rows)


@query("snk_multi_insert", """
SELECT 'big' AS target, o_orderkey FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'urgent', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def snk_multi_insert(spark, d):
    """One scan feeds three targets: each row names its targets, one write deals them out."""
    orders = table(spark, d, "orders")
    targets = F.filter(F.array(
        F.when(F.col("o_totalprice") > 300000, F.lit("big")), F.when(F.col("o_orderstatus") == "O", F.lit("open")),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent"))), lambda t: t.isNotNull())
    rows = orders.select("o_orderkey", F.explode(targets).alias("target"))
    return read_back(spark, write_new(rows, "multi", partition_by=("target",)), rows)


@query("snk_ctas", """
SELECT * FROM (VALUES ('append', 'done', 2), ('error', 'refused', 1), ('ignore', 'done', 1), ('overwrite', 'done', 1)) t(mode, outcome, times), (SELECT count(*) AS n_orders FROM orders)
""")
def snk_ctas(spark, d):
    """A second write over an existing table in every save mode; ``times`` tells how often the rows are there."""
    rows = order_rows(spark, d)
    total = rows.agg(F.count(F.lit(1)).alias("n_orders"))
    out = None
    for mode in ("append", "error", "ignore", "overwrite"):
        path = write_new(rows, "ctas")
        outcome = save_mode_result(rows, path, mode)
        found = read_back(spark, path, rows).agg(F.count(F.lit(1)).alias("n")).crossJoin(total)
        one = found.select(F.lit(mode).alias("mode"), F.lit(outcome).alias("outcome"), (F.col("n") / F.col("n_orders")).cast("int").alias("times"), "n_orders")
        out = one if out is None else out.unionByName(one)
    return out


@query("snk_directory", " UNION ALL ".join(f"SELECT '{f}' AS format, o_orderkey, o_orderstatus, o_totalprice FROM orders" for f in ("csv", "json", "orc", "parquet")))
def snk_directory(spark, d):
    rows = order_rows(spark, d)
    out = None
    for fmt in ("csv", "json", "orc", "parquet"):
        one = read_back(spark, write_new(rows, "directory", fmt), rows, fmt).withColumn("format", F.lit(fmt))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk_compressed", " UNION ALL ".join(f"SELECT '{c}' AS codec, count(*) AS n_lines, CAST(sum(length(c_name)) AS BIGINT) AS n_chars FROM customer" for c in CODECS))
def snk_compressed(spark, d):
    lines = table(spark, d, "customer").select(F.col("c_name").alias("value"))
    out = None
    for codec in CODECS:
        one = read_back(spark, write_new(lines, "compressed", "text", compression=codec), lines, "text").agg(
            F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars")).withColumn("codec", F.lit(codec))
        out = one if out is None else out.unionByName(one)
    return out


@query("prt_list_filter", "SELECT DISTINCT o_orderstatus AS status, CAST(year(o_orderdate) AS INT) AS y FROM orders WHERE year(o_orderdate) >= 1998 AND o_orderstatus <> 'P'")
def prt_list_filter(spark, d):
    """Partitions by a predicate on their columns; other folders are not read."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("y"))
    path = write_new(rows, "partitions", partition_by=("status", "y"))
    return read_back(spark, path, rows).filter("y >= 1998 AND status <> 'P'").select("status", "y").distinct()


@query("snk_batched_rows", NAMED + "SELECT stmt_id, src, dst FROM col_edges", ("f_col_lines", "f_meta_column"))
def snk_batched_rows(spark, d):
    """Relation rows in one partitioned write; Spark sizes the batches."""
    rows = job_column_edges(spark, d).select("stmt_id", "src", "dst")
    return read_back(spark, write_new(rows, "relations"), rows)


@query("meta_table_layout", """
SELECT 'o_orderkey,o_totalprice,o_orderstatus' AS columns, ',' AS delimiter, 'o_orderstatus' AS first_partition_key, count(*) AS n_rows FROM orders
""")
def meta_table_layout(spark, d):
    """Columns, field delimiter and first partition key of a partitioned text table."""
    rows = order_rows(spark, d)
    path = write_new(rows, "layout", "csv", ("o_orderstatus",))
    found = spark.read.schema(rows.schema).csv(path)
    key = F.regexp_extract("_metadata.file_path", r"([^/=]+)=[^/]+/[^/]+$", 1)
    return (found.select(key.alias("first_partition_key")).groupBy("first_partition_key").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.lit(",".join(found.columns)).alias("columns"), F.lit(",").alias("delimiter"), "first_partition_key", "n_rows"))
