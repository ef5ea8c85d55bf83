"""Table lineage: from scripts to statements, their tables and the edges between them.

All text work is row-local, so a script never leaves its task before the edges
are made distinct. The patterns cover flat statements; what they cannot read is
kept as a row with a reason (``with_status``).

Computed arrays are unfolded with the outer generators and a null filter
behind them: from the plain ones Spark infers a size filter, which it pushes
below by repeating the whole expression.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns. Literals and comments are read as a whole, whatever stands inside.
LITERAL = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+\""""
COMMENT = r"(?m:^[ \t]*--[^\n]*(?:\n|\z))|--[^\n]*|/\*(?!\+)[\s\S]*?\*/"  # a hint is no comment
FROM_IN_CALL = r"(?i)\b(?:extract|trim|substring|overlay|position)\s*\([^()]*\)"
NO_ALIAS = r"(?:on|using|where|join|left|right|full|inner|cross|lateral|group|order|sort|cluster|distribute|having|limit|union|select|insert|window)"
INPUT_TABLE = rf"(?i)(?:\b(?:from|join)\s+|(?!^)\G(?:\s+(?:as\s+)?(?!{NO_ALIAS}\b)\w+)?\s*,\s*)([A-Za-z_][\w.]*+)(?!\s*\()"
OUTPUT_TABLE = r"(?i)\b(?:insert\s+(?:into|overwrite)(?:\s+table)?|create\s+(?:external\s+|temporary\s+)?table(?:\s+if\s+not\s+exists)?)\s+(?!(?:table|local|directory|if)\b)([A-Za-z_][\w.]*)"
CTE_NAME = r"(?i)(?:\bwith\s+|,\s*)(\w+)\s+as\s*\("
CTE_QUERY = r"(?is)(?:\bwith\s+|,\s*)(\w+)\s+as\s*\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)"
USE_DATABASE = r"(?i)^use\s+`?(\w+)"
JOIN_WORDS = r"(?i)\b((?:(?:left|right|full)\s+(?:outer\s+|semi\s+)?|inner\s+|cross\s+|unique)?join)\b"

# Fixed join names by their spelling.
JOIN_KINDS = {
    "join": "JOIN", "inner join": "JOIN", "cross join": "CROSSJOIN",
    "left join": "LEFTOUTERJOIN", "left outer join": "LEFTOUTERJOIN",
    "right join": "RIGHTOUTERJOIN", "right outer join": "RIGHTOUTERJOIN",
    "full join": "FULLOUTERJOIN", "full outer join": "FULLOUTERJOIN",
    "left semi join": "LEFTSEMIJOIN", "uniquejoin": "UNIQUEJOIN",
}

DEFAULT_DATABASE = "default"


def trimmed(text: Column) -> Column:
    """Text without white space at its ends, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_comments(script: str = "script") -> Column:
    """A script without comments; a line that holds nothing else goes with its end. Literals stay as they are."""
    return F.regexp_replace(script, f"({LITERAL})|{COMMENT}", "$1")


def _open_literal(text: Column) -> Column:
    return F.rlike(F.regexp_replace(text, rf"{LITERAL}|\\.", ""), F.lit("['\"]"))


def split_script(script: Column) -> Column:
    """Array of (stmt_no, stmt), cut at every ``;`` outside literals without a backslash before it.

    Cut at every one first; pieces are glued together again while a literal is
    open. A quote that is never closed ends with the script.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.concat(F.coalesce(F.concat(acc["open"], F.lit(";")), F.lit("")), piece)
        going = _open_literal(text)
        return F.struct(F.when(going, acc["done"]).otherwise(F.array_append(acc["done"], text)).alias("done"),
                        F.when(going, text).alias("open"))

    plain = F.split(script, r"(?<!\\);")
    glued = F.aggregate(plain, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    parts = F.when(F.rlike(script, F.lit("['\"]")), glued).otherwise(plain)
    return F.transform(parts, lambda s, i: F.struct(i.alias("stmt_no"), trimmed(s).alias("stmt")))


def bare(stmt: Column) -> Column:
    """A statement as the table patterns read it: no literals, no back quotes, no FROM inside a call."""
    return F.regexp_replace(F.replace(F.regexp_replace(stmt, LITERAL, "''"), F.lit("`"), F.lit("")), FROM_IN_CALL, "f()")


def is_query(stmt: Column) -> Column:
    """Statements that can carry lineage; blank, ``set`` and ``add`` ones do not."""
    return (stmt != "") & ~F.rlike(stmt, F.lit(r"(?i)^(set|add)\b"))


def statements(jobs: DataFrame, *keep: str) -> DataFrame:
    """(job_id, .., stmt_no, stmt) of every script."""
    parts = split_script(strip_comments())
    return (jobs.select(F.col("id").alias("job_id"), *keep, F.inline(parts))
            .filter(is_query(F.col("stmt"))))


def scoped_statements(jobs: DataFrame, *keep: str) -> DataFrame:
    """Statements with the database in force, as set by the nearest ``use`` before them.

    Each script carries its short list of ``use`` places, so no rows need to
    be sorted.
    """
    def places(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda p: F.struct(
            p["stmt_no"].alias("at"), F.regexp_extract(p["stmt"], USE_DATABASE, 1).alias("db"))), lambda u: u["db"] != "")

    split = jobs.select(F.col("id").alias("job_id"), *keep, split_script(strip_comments()).alias("parts"))
    rows = split.withColumn("uses", places(F.col("parts"))).select("job_id", *keep, "uses", F.inline_outer("parts"))
    current = F.expr("try_element_at(filter(uses, u -> u.at <= stmt_no), -1).db")
    return (rows.filter(is_query(F.col("stmt")))
            .withColumn("database_name", F.coalesce(current, F.lit(DEFAULT_DATABASE))).drop("uses"))


def _names(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def input_names(stmt: str = "stmt") -> Column:
    """Names after FROM and JOIN, comma lists included; WITH names among them."""
    return F.array_distinct(_names(bare(F.col(stmt)), INPUT_TABLE))


def output_names(stmt: str = "stmt") -> Column:
    return F.array_distinct(_names(bare(F.col(stmt)), OUTPUT_TABLE))


def cte_names(stmt: str = "stmt") -> Column:
    return F.array_distinct(_names(bare(F.col(stmt)), CTE_NAME))


def real_input_names(stmt: str = "stmt") -> Column:
    """Names of tables that are read. A WITH name stands for its query only after that query, whatever its case."""
    text = bare(F.col(stmt))

    def tables(body: Column, hidden: Column) -> Column:
        return F.filter(_names(body, INPUT_TABLE), lambda n: ~F.array_contains(hidden, F.lower(n)))

    names = F.transform(_names(text, CTE_QUERY), lambda n: F.lower(n))
    bodies = F.zip_with(_names(text, CTE_QUERY), F.regexp_extract_all(text, F.lit(CTE_QUERY), F.lit(2)), lambda n, b: F.struct(F.lower(n).alias("name"), b.alias("body")))
    start = F.struct(F.array().cast("array<string>").alias("known"), F.array().cast("array<string>").alias("read"))
    inside = F.aggregate(bodies, start, lambda acc, c: F.struct(
        F.array_append(acc["known"], c["name"]).alias("known"), F.concat(acc["read"], tables(c["body"], acc["known"])).alias("read")), lambda acc: acc["read"])
    outside = tables(F.regexp_replace(text, CTE_QUERY, " "), names)
    plain = F.array_distinct(_names(text, INPUT_TABLE))
    return F.when(F.rlike(text, F.lit(CTE_NAME)), F.array_distinct(F.concat(inside, outside))).otherwise(plain)


def qualify(name: Column, database: Column) -> Column:
    """Database put before every bare name of an ``&`` list; three-part names give null."""
    parts = F.split(name, "&")
    bad = F.exists(parts, lambda p: F.size(F.split(p, r"\.")) > 2)
    full = F.transform(parts, lambda p: F.when(F.contains(p, F.lit(".")), p).otherwise(F.concat(database, F.lit("."), p)))
    return F.when(~bad, F.array_join(full, "&"))


def table_refs(jobs: DataFrame, *keep: str) -> DataFrame:
    """Statements with qualified ``inputs`` (without WITH names) and ``outputs``."""
    def full(names: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(names, lambda n: qualify(n, F.col("database_name"))), lambda n: n.isNotNull()))

    scoped = scoped_statements(jobs, *keep)
    return (scoped.withColumn("inputs", full(real_input_names()))
            .withColumn("outputs", full(output_names())))


def name_list(names: Column) -> Column:
    """Names as ``a;b;c`` in sorted order."""
    return F.array_join(F.array_sort(names), ";")


def table_edges(refs: DataFrame) -> DataFrame:
    """Distinct (src_db, src_table, dst_db, dst_table) over all statements."""
    sources = refs.select(F.explode_outer("inputs").alias("src"), "outputs").filter("src is not null")
    pairs = sources.select("src", F.explode_outer("outputs").alias("dst")).filter("dst is not null").distinct()
    return pairs.select(
        F.substring_index("src", ".", 1).alias("src_db"), F.substring_index("src", ".", -1).alias("src_table"),
        F.substring_index("dst", ".", 1).alias("dst_db"), F.substring_index("dst", ".", -1).alias("dst_table"))


def with_status(refs: DataFrame) -> DataFrame:
    """Every statement with what could be read from it."""
    status = (F.when(F.rlike("stmt", F.lit(r"(?i)^use\b")), "database")
              .when((F.size("inputs") == 0) & (F.size("outputs") == 0), "no table")
              .when(F.size("outputs") == 0, "no output table")
              .when(F.size("inputs") == 0, "no input table").otherwise("ok"))
    return refs.withColumn("status", status)


def join_kinds(stmt: str = "stmt") -> Column:
    """Kinds of the joins of a statement, in order, duplicates kept."""
    names = F.create_map(*[F.lit(x) for pair in JOIN_KINDS.items() for x in pair])
    words = F.regexp_extract_all(stmt, F.lit(JOIN_WORDS), F.lit(1))
    plain = F.transform(words, lambda w: F.try_element_at(names, F.regexp_replace(F.lower(w), r"\s+", " ")))
    hinted = F.rlike(stmt, F.lit(r"(?i)/\*\+\s*mapjoin"))
    return F.when(hinted, F.transform(plain, lambda k: F.lit("MAPJOIN"))).otherwise(plain)
