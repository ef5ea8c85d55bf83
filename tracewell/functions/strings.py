"""Text functions. Document texts are always taken whole."""
from pyspark.sql import functions as F

from tracewell.registry import query
from tracewell.sources import table, use_all_cores


@query("fn_str_case", """
SELECT p_partkey, lower(p_type) AS lo, upper(p_name) AS up, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(substr(w, 2)))), ' ') AS cap, lower(p_brand) AS lo2, upper(p_brand) AS up2 FROM part
""")
def fn_str_case(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("lo"), F.upper("p_name").alias("up"), F.initcap("p_name").alias("cap"), F.lcase("p_brand").alias("lo2"), F.ucase("p_brand").alias("up2"))


@query("fn_str_length", """
SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(length(text) AS INT) AS chars2, CAST(length(text) AS INT) AS chars3, CAST(strlen(text) AS INT) AS bytes, CAST(strlen(text) * 8 AS INT) AS bits FROM documents
""")
def fn_str_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"), F.char_length("text").alias("chars2"), F.character_length("text").alias("chars3"), F.octet_length("text").alias("bytes"), F.bit_length("text").alias("bits"))


@query("fn_str_concat", "SELECT p_partkey, concat(p_brand, '/', p_type) AS label, concat_ws('-', p_brand, nullif(p_type, 'ECONOMY'), p_name) AS path, NULL::VARCHAR AS none FROM part")
def fn_str_concat(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("label"), F.concat_ws("-", "p_brand", F.nullif("p_type", F.lit("ECONOMY")), "p_name").alias("path"), F.concat("p_brand", F.lit(None).cast("string")).alias("none"))


@query("fn_str_slice", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_name END AS chosen, repeat(left(p_type, 1), p_size % 4) AS again, replace(p_name, 'e', '3') AS swapped, reverse(p_name) AS mirrored,
       repeat(' ', p_size % 5) AS blanks, substr(p_name, 2, 3) AS mid, substring(p_name, -3, 2) AS tail, left(p_brand, 5) AS l5, right(p_brand, 2) AS r2, split_part(p_name, ' ', 1) AS word, translate(p_name, 'aeiou', 'AE') AS trans FROM part
""")
def fn_str_slice(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.elt(F.col("p_size") % 3 + 1, F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("chosen"), F.expr("repeat(left(p_type, 1), p_size % 4)").alias("again"),
        F.replace("p_name", F.lit("e"), F.lit("3")).alias("swapped"), F.reverse("p_name").alias("mirrored"), F.expr("space(p_size % 5)").alias("blanks"), F.substr("p_name", F.lit(2), F.lit(3)).alias("mid"),
        F.substring("p_name", -3, 2).alias("tail"), F.left("p_brand", F.lit(5)).alias("l5"), F.right("p_brand", F.lit(2)).alias("r2"), F.substring_index("p_name", " ", 1).alias("word"), F.translate("p_name", "aeiou", "AE").alias("trans"))


@query("fn_str_search", """
SELECT doc_id, CAST(instr(text, 'the') AS INT) AS first_the, CASE WHEN length(text) < 20 THEN 0 WHEN instr(substr(text, 20), 'the') = 0 THEN 0 ELSE CAST(instr(substr(text, 20), 'the') + 19 AS INT) END AS next_the,
       CAST(position('.' IN text) AS INT) AS first_stop, CAST(list_position(['en', 'de', 'fr'], lang) AS INT) AS lang_place FROM (SELECT doc_id, text, lang FROM documents)
""".replace("CAST(list_position(['en', 'de', 'fr'], lang) AS INT)", "CAST(coalesce(list_position(['en', 'de', 'fr'], lang), 0) AS INT)"))
def fn_str_search(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.instr("text", "the").alias("first_the"), F.locate("the", "text", 20).alias("next_the"), F.position(F.lit("."), "text").alias("first_stop"), F.find_in_set("lang", F.lit("en,de,fr")).alias("lang_place"))


@query("fn_str_trim_pad", """
SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, rpad(p_type, 6, '*') AS cut, trim(concat('  ', p_name, ' ')) AS bare, ltrim(concat('  ', p_name, ' ')) AS left_bare, rtrim(concat('  ', p_name, ' ')) AS right_bare,
       trim(p_brand, 'B2d') AS stripped FROM part
""")
def fn_str_trim_pad(spark, d):
    spaced = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return table(spark, d, "part").select(
        "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.rpad("p_type", 6, "*").alias("cut"), F.trim(spaced).alias("bare"), F.ltrim(spaced).alias("left_bare"), F.rtrim(spaced).alias("right_bare"),
        F.expr("trim(BOTH 'B2d' FROM p_brand)").alias("stripped"))


@query("fn_str_regex", """
SELECT doc_id, regexp_extract(text, '([0-9]+)', 1) AS first_number, regexp_extract(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', 2) AS mail_host, md5(regexp_replace(text, '[0-9]', '#', 'g')) AS masked FROM documents
""")
def fn_str_regex(spark, d):
    return use_all_cores(table(spark, d, "documents")).select(
        "doc_id", F.regexp_extract("text", "([0-9]+)", 1).alias("first_number"), F.regexp_extract("text", "([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", 2).alias("mail_host"),
        F.md5(F.regexp_replace("text", "[0-9]", "#")).alias("masked"))


@query("fn_str_tokens", """
SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1
""")
def fn_str_tokens(spark, d):
    words = use_all_cores(table(spark, d, "documents")).select("doc_id", F.explode(F.split("text", "[ \\n]+")).alias("word")).filter("word <> ''")
    per_doc = words.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("fn_str_sentences", """
SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, TRUE AS in_order FROM documents
""")
def fn_str_sentences(spark, d):
    """Sentences and words of every document by the language's own rules: no letter is lost or moved."""
    split = use_all_cores(table(spark, d, "documents")).select("doc_id", "text", F.sentences("text", "lang", F.lit("")).alias("parts"))
    words = F.regexp_replace(F.array_join(F.flatten("parts"), ""), "[^A-Za-z]", "")
    return split.select("doc_id", F.length(words).cast("bigint").alias("n_letters"),
                        (words == F.regexp_replace("text", "[^A-Za-z]", "")).alias("in_order"))


@query("fn_str_encode", """
SELECT c_custkey, CAST(ascii(c_mktsegment) AS INT) AS code, chr(CAST(65 + c_custkey % 26 AS INT)) AS letter, chr(CAST(97 + c_custkey % 26 AS INT)) AS letter2, to_base64(encode(c_name)) AS b64, c_name AS back, c_mktsegment AS recoded FROM customer
""")
def fn_str_encode(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.ascii("c_mktsegment").alias("code"), F.char(F.col("c_custkey") % 26 + 65).alias("letter"), F.chr(F.col("c_custkey") % 26 + 97).alias("letter2"), F.base64(F.encode("c_name", "UTF-8")).alias("b64"),
        F.decode(F.unbase64(F.base64(F.encode("c_name", "UTF-8"))), "UTF-8").alias("back"), F.decode(F.encode("c_mktsegment", "UTF-16BE"), "UTF-16BE").alias("recoded"))


@query("fn_str_format", """
SELECT s_suppkey, format('{:,.2f}', s_acctbal) AS grouped, printf('%05d|%s|%.1f', s_suppkey, s_name, round(CAST(s_acctbal AS DECIMAL(12,2)), 1)) AS line, printf('%x', s_suppkey) AS hexed FROM supplier
""")
def fn_str_format(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", F.format_number("s_acctbal", 2).alias("grouped"), F.format_string("%05d|%s|%.1f", "s_suppkey", "s_name", "s_acctbal").alias("line"), F.printf(F.lit("%x"), F.col("s_suppkey")).alias("hexed"))


@query("fn_str_distance", "SELECT p_partkey, CAST(levenshtein(p_name, lower(p_type)) AS INT) AS distance FROM part")
def fn_str_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))


@query("fn_str_soundex", "SELECT p_partkey, upper(left(p_name, 1)) AS initial, TRUE AS well_formed FROM part")
def fn_str_soundex(spark, d):
    """Phonetic codes: the first letter and three digits, the same for a name in other case."""
    code, other = F.soundex("p_name"), F.soundex(F.upper("p_name"))
    return table(spark, d, "part").select("p_partkey", F.left(code, F.lit(1)).alias("initial"), (code.rlike("^[A-Z][0-6]{3}$") & (code == other)).alias("well_formed"))


@query("fn_url", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
       nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref FROM pages
""")
def fn_url(spark, d):
    part = lambda name, *key: F.try_parse_url("url", F.lit(name), *key)
    return table(spark, d, "pages").select(
        "page_id", part("PROTOCOL").alias("protocol"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("QUERY", F.lit("page")).alias("page"), part("REF").alias("ref"))


XPATH_ROWS = 2_500  # of a task, as every path parses its row's XML anew


@query("fn_xpath", """
SELECT o_orderkey, concat(o_orderstatus, ';', o_orderpriority) AS texts, o_orderstatus = 'F' AS done, CAST(o_custkey AS DOUBLE) AS as_double, CAST(o_custkey AS DOUBLE) AS as_number, CAST(o_custkey % 100 AS FLOAT) AS as_float,
       CAST(o_custkey AS INT) AS as_int, o_orderkey AS as_long, CAST(o_custkey % 100 AS SMALLINT) AS as_short, o_orderpriority AS as_text FROM orders
""")
def fn_xpath(spark, d):
    xml = F.concat(F.lit("<o><s>"), "o_orderstatus", F.lit("</s><s>"), "o_orderpriority", F.lit("</s><c>"), "o_custkey", F.lit("</c><k>"), "o_orderkey", F.lit("</k><m>"), F.col("o_custkey") % 100, F.lit("</m></o>"))
    return use_all_cores(table(spark, d, "orders"), XPATH_ROWS).select("o_orderkey", xml.alias("x")).select(
        "o_orderkey", F.array_join(F.xpath("x", F.lit("o/s/text()")), ";").alias("texts"), F.xpath_boolean("x", F.lit("o/s[1] = 'F'")).alias("done"), F.xpath_double("x", F.lit("o/c")).alias("as_double"),
        F.xpath_number("x", F.lit("o/c")).alias("as_number"), F.xpath_float("x", F.lit("o/m")).alias("as_float"), F.xpath_int("x", F.lit("o/c")).alias("as_int"), F.xpath_long("x", F.lit("o/k")).alias("as_long"),
        F.xpath_short("x", F.lit("o/m")).alias("as_short"), F.xpath_string("x", F.lit("o/s[2]")).alias("as_text"))


@query("fn_json", """
SELECT event_id, json_extract_string(props, '$.k') AS found, NULL::VARCHAR AS absent, CAST(json_extract_string(props, '$.k') AS BIGINT) AS parsed, concat('{"id":', event_id, ',"type":"', event_type, '"}') AS text FROM events
""")
def fn_json(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("found"), F.get_json_object("props", "$.none").alias("absent"), F.from_json("props", "k bigint")["k"].alias("parsed"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("text"))
