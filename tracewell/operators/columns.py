"""Column lineage: select items, their source columns and what becomes of them.

Statements are cut into scopes (a WITH query or a UNION branch), scopes into
select items, items into column references. References are then bound to
tables through aliases and metadata by joins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.skew import lookup_join
from tracewell.operators.statements import CTE_QUERY, LITERAL, trimmed
from tracewell.storage import cut

# Fixed patterns.
FROM_QUERY = r"(?is)\b(?:from|join)\s*(\(\s*(select\b(?:[^()]++|\((?!\s*select\b)(?:[^()]++|\((?!\s*select\b)[^()]*+\))*+\))*+)\))"
BRANCH_BORDER = r"(?i)\bunion(?:\s+all|\s+distinct)?\b"
SELECT_LIST = r"(?is)\bselect\s+(?:distinct\s+)?(.*?)\s+from\s"
FROM_CLAUSE = r"(?is)\sfrom\s+(.*)$"
SOURCE_WITH_ALIAS = r"(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)(?:\s+(?:as\s+)?([A-Za-z_]\w*))?"
ITEM_WITH_AS = r"(?is)^(.*\S)\s+as\s+(\w+)$"
ITEM_WITH_ALIAS = r"(?is)^(.*[\w)\]'])\s+(\w+)$"
NO_COLUMNS = (  # what an expression names besides columns, and what stays of it
    (LITERAL, "''"),
    (r"`", ""),
    (r"(?i)\b(?:date|timestamp)\s*''", "''"),
    (r"(?i)\binterval\s+(?:''|\d+)\s+\w+", "''"),
    (r"(?i)\bextract\s*\(\s*\w+\s+from\b", "extract("),
    (r"(?i)\bas\s+\w+(?:\s*\([^()]*\)|\s*<[^()]*>)?\s*\)", ")"),
    (r"(?i)\b(?:rows|range)\s+(?:between\s+)?(?:unbounded|current|\d+)\b[^()]*", ""),
    (r"(?<![\w.])\d(?:[\w.]*[eE][+-]\d+|[\w.]*)", "0"),
)
IDENTIFIER = r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?:\s*(\())?"
WHERE_TEXT = r"(?is)\bwhere\s+(.*?)(?:\s+(?:group|order|sort|cluster|distribute)\s+by\b.*|\s+having\b.*|\s+limit\b.*)?$"
JOIN_TEXT = r"(?is)\b((?:(?:left|right|full)\s+(?:outer\s+|semi\s+)?|inner\s+|cross\s+)?join)\s+[\w.]+(?:\s+(?:as\s+)?\w+)?\s+on\s+(.*?)(?=\s+(?:(?:left|right|full|inner|cross)\s+(?:outer\s+|semi\s+)?)?join\s|\s+lateral\s+view\s|\s+where\s|\s+group\s+by\s|\s+order\s+by\s|$)"

# Fixed words that are no column and no alias.
SQL_WORDS = (
    "all", "and", "as", "asc", "between", "by", "case", "cast", "cross", "desc", "distinct", "div", "else", "end",
    "exists", "false", "from", "full", "group", "having", "in", "inner", "is", "join", "lateral", "left", "like",
    "limit", "not", "null", "on", "or", "order", "outer", "over", "partition", "regexp", "right", "rlike", "select",
    "semi", "sort", "then", "true", "union", "using", "view", "when", "where", "with",
)
SPECIAL_JOIN_NAMES = {"leftjoin": "LEFTOUTERJOIN", "rightjoin": "RIGHTOUTERJOIN", "fulljoin": "FULLOUTERJOIN", "innerjoin": "JOIN"}


def _words() -> Column:
    return F.array(*[F.lit(w) for w in SQL_WORDS])


def peeled(stmt: str = "stmt") -> Column:
    """A statement with every query in FROM or JOIN replaced by a scope name, and those scopes.

    Struct of ``text`` and ``inner`` (scope, body). The innermost query goes first,
    one per step, and there are as many steps as there are queries in parentheses.
    A query keeps its alias behind the scope name.
    """
    start = F.struct(F.col(stmt).alias("text"), F.array().cast("array<struct<scope:string,body:string>>").alias("inner"))

    def step(acc: Column, number: Column) -> Column:
        whole = F.regexp_extract(acc["text"], FROM_QUERY, 1)
        name = F.concat(F.lit("from_query_"), number)
        at = F.instr(acc["text"], whole)
        text = F.concat(F.substring(acc["text"], F.lit(1), at - 1), F.lit(" "), name, F.lit(" "), F.substring(acc["text"], at + F.length(whole), F.length(acc["text"])))
        inner = F.array_append(acc["inner"], F.struct(name.alias("scope"), F.regexp_extract(acc["text"], FROM_QUERY, 2).alias("body")))
        return F.when(whole == "", acc).otherwise(F.struct(text.alias("text"), inner.alias("inner")))

    steps = F.regexp_count(stmt, F.lit(r"(?i)\b(?:from|join)\s*\(\s*select\b"))
    return F.when(steps == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step))


def scopes(statements: DataFrame, *keys: str) -> DataFrame:
    """(keys, scope, branch, text): one row per WITH query, query in FROM and UNION branch.

    The scope of the statement itself is the empty name.
    """
    text = F.col("_peeled.text")
    names = F.regexp_extract_all(text, F.lit(CTE_QUERY), F.lit(1))
    texts = F.regexp_extract_all(text, F.lit(CTE_QUERY), F.lit(2))
    parts = F.concat(
        F.col("_peeled.inner"),
        F.zip_with(names, texts, lambda n, t: F.struct(n.alias("scope"), t.alias("body"))),
        F.array(F.struct(F.lit("").alias("scope"), F.regexp_replace(text, CTE_QUERY, " ").alias("body"))))
    return (statements.withColumn("_peeled", peeled()).select(*keys, F.inline(parts))
            .select(*keys, "scope", F.posexplode(F.split("body", BRANCH_BORDER)).alias("branch", "text"))
            .withColumn("text", trimmed(F.col("text")))
            .filter(F.rlike("text", F.lit(r"(?i)\bselect\b"))))


def _depth_change(piece: Column) -> Column:
    bare = F.regexp_replace(piece, LITERAL, "")
    opened = F.length(bare) - F.length(F.translate(bare, "(", ""))
    closed = F.length(bare) - F.length(F.translate(bare, ")", ""))
    return opened - closed


def split_items(select_list: Column) -> Column:
    """A select list cut at commas outside parentheses and quotes.

    The text is cut at every comma, pieces are glued together again while a
    parenthesis or a quote is open.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("started"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc["started"], F.concat(acc["open"], F.lit(","), piece)).otherwise(piece)
        quotes = (F.length(text) - F.length(F.translate(text, "'", ""))) % 2
        whole = (quotes == 0) & (_depth_change(text) <= 0)
        return F.struct(
            F.when(whole, F.array_append(acc["done"], trimmed(text))).otherwise(acc["done"]).alias("done"),
            F.when(whole, F.lit("")).otherwise(text).alias("open"),
            (~whole).alias("started"))

    return F.aggregate(F.split(select_list, ","), start, step, lambda acc: F.when(
        acc["started"], F.array_append(acc["done"], trimmed(acc["open"]))).otherwise(acc["done"]))


def select_items(scoped: DataFrame, *keys: str) -> DataFrame:
    """(keys, scope, branch, pos, expr, name): the select list of every scope.

    The name is the alias, else the last part of a plain column, else empty.
    """
    items = split_items(F.regexp_extract("text", SELECT_LIST, 1))
    item = F.col("item")
    named = F.regexp_extract(item, ITEM_WITH_AS, 2)
    spaced = F.regexp_extract(item, ITEM_WITH_ALIAS, 2)
    spaced_ok = (spaced != "") & ~F.array_contains(_words(), F.lower(spaced))
    plain = F.regexp_extract(item, r"^(?:\w+\.)*([A-Za-z_]\w*)$", 1)
    return (scoped.select(*keys, "scope", "branch", F.posexplode(items).alias("pos", "item"))
            .withColumn("expr", F.when(named != "", F.regexp_extract(item, ITEM_WITH_AS, 1))
                        .when(spaced_ok, F.regexp_extract(item, ITEM_WITH_ALIAS, 1)).otherwise(item))
            .withColumn("name", F.when(named != "", named).when(spaced_ok, spaced).otherwise(plain))
            .select(*keys, "scope", "branch", "pos", "expr", "name"))


def column_refs(expr: str = "expr") -> Column:
    """Columns an expression names, in order of first use.

    Literals, numbers, types of casts, window frames, SQL words and function
    names are left out; the name in front of ``[..]`` stays. ``*`` and ``a.*`` come through as they are.
    """
    bare = F.col(expr)
    for pattern, left in NO_COLUMNS:
        bare = F.regexp_replace(bare, pattern, left)
    names = F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(1))
    calls = F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(2))
    kept = F.filter(F.arrays_zip(names.alias("name"), calls.alias("call")),
                    lambda z: (z["call"] == "") & ~F.array_contains(_words(), F.lower(z["name"])))
    star = F.rlike(expr, F.lit(r"^(\w+\.)?\*$"))
    return F.when(star, F.array(F.col(expr))).otherwise(F.array_distinct(F.transform(kept, lambda z: z["name"])))


def scope_sources(scoped: DataFrame, *keys: str) -> DataFrame:
    """(keys, scope, branch, place, source, alias): tables of every scope.

    A table without an alias goes by its own last name.
    """
    text = F.col("text")
    names = F.regexp_extract_all(text, F.lit(SOURCE_WITH_ALIAS), F.lit(1))
    aliases = F.regexp_extract_all(text, F.lit(SOURCE_WITH_ALIAS), F.lit(2))
    pairs = F.arrays_zip(names.alias("source"), aliases.alias("alias"))
    return (scoped.select(*keys, "scope", "branch", F.posexplode(pairs).alias("place", "p"))
            .select(*keys, "scope", "branch", "place", F.col("p.source").alias("source"), F.col("p.alias").alias("alias"))
            .withColumn("alias", F.when((F.col("alias") == "") | F.array_contains(_words(), F.lower("alias")),
                                        F.substring_index("source", ".", -1)).otherwise(F.col("alias"))))


def conditions(text: str = "text") -> Column:
    """WHERE and join conditions as ``WHERE:..``, ``JOIN:..``, ``LEFTOUTERJOIN:..``."""
    flat = F.regexp_replace(text, r"\s+", " ")
    kinds = F.regexp_extract_all(flat, F.lit(JOIN_TEXT), F.lit(1))
    texts = F.regexp_extract_all(flat, F.lit(JOIN_TEXT), F.lit(2))

    def label(kind: Column) -> Column:
        joined = F.replace(F.lower(kind), F.lit(" "), F.lit(""))
        out = F.upper(joined)
        for spelling, name in SPECIAL_JOIN_NAMES.items():
            out = F.when(joined == spelling, F.lit(name)).otherwise(out)
        return out

    joins = F.zip_with(kinds, texts, lambda k, t: F.concat(label(k), F.lit(":"), trimmed(t)))
    where = trimmed(F.regexp_extract(flat, WHERE_TEXT, 1))
    return F.concat(joins, F.when(where != "", F.array(F.concat(F.lit("WHERE:"), where))).otherwise(F.array().cast("array<string>")))


def resolve_aliases(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """References with the table their alias stands for; bare ones keep null.

    ``refs(stmt_id, pos, alias, column_name)``, ``sources(stmt_id, alias,
    database_name, table_name, place)``. A reference may use the table name.
    """
    names = sources.select("stmt_id", F.explode(F.array_distinct(F.array("alias", "table_name"))).alias("alias"), "database_name", "table_name")
    return refs.join(names, ["stmt_id", "alias"], "left")


def candidate_tables(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Bare references paired with every table in the scope of their statement."""
    bare = refs.filter((F.col("alias") == "") & (F.col("column_name") != "*"))
    return bare.join(sources.drop("alias"), "stmt_id")


def bind_bare(refs: DataFrame, sources: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Bare references with the tables that have such a column, in ``owners``."""
    columns = meta_columns.select("database_name", "table_name", F.lower("column_name").alias("key"))
    pairs = candidate_tables(refs, sources).withColumn("key", F.lower("column_name"))
    hits = lookup_join(pairs, columns, ["database_name", "table_name", "key"])
    owners = hits.groupBy("stmt_id", "pos", "column_name").agg(
        F.array_sort(F.collect_set(F.concat_ws(".", "database_name", "table_name"))).alias("owners"))
    return owners


def expand_stars(refs: DataFrame, sources: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """``*`` and ``a.*`` written out from metadata: tables in FROM order, columns in table order."""
    stars = refs.filter(F.col("column_name") == "*").select("stmt_id", "pos", F.col("alias").alias("star_alias"))
    tables = stars.join(sources, "stmt_id").filter((F.col("star_alias") == "") | (F.col("star_alias") == F.col("alias")))
    columns = meta_columns.select("database_name", "table_name", "ordinal", "column_name")
    return lookup_join(tables, columns, ["database_name", "table_name"]).select(
        "stmt_id", "pos", "place", "ordinal", "database_name", "table_name", "column_name")


def collapse_scopes(scope_columns: DataFrame) -> DataFrame:
    """Output columns of the outermost scopes with their base sources.

    ``scope_columns(stmt_id, scope_id, column_name, child_scope_id, source,
    cond)``: a column reads a child scope's column of the same name or a base
    source. Conditions met on the way are carried along. Each round replaces
    one level of references by what they stand for. A scope that turns up again
    on its own way ends it.
    """
    inner = scope_columns.select("stmt_id", F.col("scope_id").alias("child_scope_id"), "column_name",
                                 F.col("child_scope_id").alias("n_child"), F.col("source").alias("n_source"), F.col("cond").alias("n_cond"))
    frontier = (scope_columns.filter("scope_id = 1")
                .select("stmt_id", "column_name", "child_scope_id", "source", F.array(F.lit(1)).alias("seen"),
                        F.filter(F.array("cond"), lambda c: c.isNotNull()).alias("conds")))
    out = frontier.filter("child_scope_id is null")
    while True:
        frontier = cut(
            frontier.filter("child_scope_id is not null and not array_contains(seen, child_scope_id)")
            .join(inner, ["stmt_id", "child_scope_id", "column_name"])
            .select("stmt_id", "column_name", F.col("n_child").alias("child_scope_id"), F.col("n_source").alias("source"),
                    F.array_append("seen", F.col("child_scope_id")).alias("seen"),
                    F.concat("conds", F.filter(F.array("n_cond"), lambda c: c.isNotNull())).alias("conds")))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.filter("child_scope_id is null"))
    return out.select("stmt_id", "column_name", "source", F.array_sort(F.array_distinct("conds")).alias("conds"))


def scope_children(scoped: DataFrame) -> DataFrame:
    """(stmt_id, scope_id, children, nearest_named): direct children and the closest named scope around.

    A statement's scopes are few and form one short array per statement.
    """
    trees = scoped.groupBy("stmt_id").agg(F.array_sort(F.collect_list(F.struct("scope_id", "parent_id", "alias"))).alias("tree"))
    rows = trees.select("stmt_id", "tree", F.inline("tree"))
    children = F.transform(F.filter("tree", lambda t: t["parent_id"] == F.col("scope_id")), lambda t: t["scope_id"])
    climb = F.aggregate(
        "tree", F.struct(F.col("parent_id").alias("at"), F.lit("").alias("name")),
        lambda acc, _: F.when(acc["name"] != "", acc).otherwise(F.struct(
            F.coalesce(F.get(F.filter("tree", lambda t: t["scope_id"] == acc["at"]), F.lit(0))["parent_id"], F.lit(0)).alias("at"),
            F.coalesce(F.get(F.filter("tree", lambda t: t["scope_id"] == acc["at"]), F.lit(0))["alias"], F.lit("")).alias("name"))),
        lambda acc: acc["name"])
    return rows.select("stmt_id", "scope_id", F.array_sort(children).alias("children"), climb.alias("nearest_named"))


def merge_union_branches(lines: DataFrame) -> DataFrame:
    """Branches of a UNION merged by output position.

    ``lines(stmt_id, branch, pos, to_name, expr, from_names, to_table, cond)``.
    Sources and conditions are united, expressions joined with ``&`` in branch
    order, the first usable name stays.
    """
    ordered = F.array_sort(F.collect_list(F.struct("branch", "to_name", "expr", "from_names", "cond")))
    merged = lines.groupBy("stmt_id", "pos", "to_table").agg(ordered.alias("parts"))
    usable = F.filter("parts", lambda p: p["to_name"] != "")
    return merged.select(
        "stmt_id", "pos", "to_table",
        F.coalesce(F.get(usable, F.lit(0))["to_name"], F.lit("")).alias("to_name"),
        F.array_join(F.transform("parts", lambda p: p["expr"]), "&").alias("expr"),
        F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["from_names"]))).alias("from_names"),
        F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["cond"]))).alias("conditions"))


def branch_mismatch(lines: DataFrame) -> DataFrame:
    """Statements whose UNION branches differ in column count or target."""
    per_branch = lines.groupBy("stmt_id", "branch").agg(
        F.count(F.lit(1)).alias("n"), F.min("to_table").alias("lo"), F.max("to_table").alias("hi"))
    per_stmt = per_branch.groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("n_branches"), F.min("n").alias("min_columns"), F.max("n").alias("max_columns"),
        (F.min("lo") != F.max("hi")).alias("targets_differ"))
    return per_stmt.filter("min_columns <> max_columns or targets_differ")


def is_computed(expr: str, from_names: Column) -> Column:
    """Whether an expression is more than one of its plain sources."""
    return F.exists(F.split(F.col(expr), "&"), lambda part: ~F.array_contains(from_names, part))


def condition_map(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, texts): ``KIND:text`` conditions collected per kind, cut at the first colon."""
    cut_at = F.instr("cond", ":")
    parts = lines.filter(cut_at > 1).select(
        *keys, F.expr("substr(cond, 1, instr(cond, ':') - 1)").alias("kind"), F.expr("substr(cond, instr(cond, ':') + 1)").alias("text"))
    return parts.groupBy(*keys, "kind").agg(F.array_sort(F.collect_set("text")).alias("texts"))


def positional_names(lines: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Lines with the metadata column at their position, when the column counts agree.

    ``lines(stmt_id, pos, to_name, to_table)``. Otherwise the parsed name stays.
    """
    per_table = meta_columns.groupBy(F.concat_ws(".", "database_name", "table_name").alias("to_table")).agg(
        F.count(F.lit(1)).alias("n_meta"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]).alias("names"))
    counts = lines.groupBy("stmt_id", "to_table").agg(F.count(F.lit(1)).alias("n_lines"))
    counted = lines.join(counts, ["stmt_id", "to_table"])
    return lookup_join(counted, per_table, ["to_table"], how="left").withColumn(
        "out_name", F.when(F.col("n_lines") == F.col("n_meta"), F.get("names", F.col("pos") - 1)).otherwise(F.col("to_name"))
    ).drop("names", "n_meta", "n_lines")


def column_edges(lines: DataFrame, *keep: str) -> DataFrame:
    """(.., src, dst): one row per output column and three-part source, ``&`` lists split."""
    return (lines.select(*keep, F.explode(F.split("from_names", "&")).alias("src"), F.concat_ws(".", "to_table", "out_name").alias("dst"))
            .filter(F.size(F.split("src", r"\.")) == 3))


def relation_rows(edges: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Edges with column and table ids of both ends; an end without metadata has nulls."""
    ids = meta_columns.select(F.lower(F.concat_ws(".", "database_name", "table_name", "column_name")).alias("key"), "column_id", "table_id")
    src = lookup_join(edges.withColumn("key", F.lower("src")), ids.withColumnsRenamed({"column_id": "from_column_id", "table_id": "from_table_id"}), ["key"], "left").drop("key")
    return lookup_join(src.withColumn("key", F.lower("dst")), ids, ["key"], "left").drop("key")


def trace_columns(refs: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Column lineage from statement text: (job_id, stmt_no, to_table, pos, to_name, source).

    ``refs`` comes from ``statements.table_refs``. A reference is bound in the
    row of its scope: an alias names its table, a bare column belongs to the
    only table there; with several tables the ones that have such a column
    count. Columns of WITH queries are then replaced by their own sources,
    one level per round. ``table.*`` stays a source of that name.
    """
    keys = ["job_id", "stmt_no"]
    refs = cut(refs.select(*keys, "database_name", "stmt", "outputs"))
    scoped = cut(scopes(refs, *keys, "database_name"))
    names = F.regexp_extract_all("text", F.lit(SOURCE_WITH_ALIAS), F.lit(1))
    aliases = F.regexp_extract_all("text", F.lit(SOURCE_WITH_ALIAS), F.lit(2))
    sources = F.zip_with(names, aliases, lambda n, a: F.struct(
        n.alias("source"), F.when((a == "") | F.array_contains(_words(), F.lower(a)), F.substring_index(n, ".", -1)).otherwise(a).alias("alias")))
    items = cut(select_items(scoped.withColumn("sources", sources), *keys, "database_name", "sources"))
    named = items.select(*keys, "database_name", "sources", "scope", "branch", "pos", "name", F.explode_outer(column_refs()).alias("ref"))
    named = named.filter("ref is not null").withColumn("column", F.substring_index("ref", ".", -1)).withColumn(
        "alias", F.when(F.contains("ref", F.lit(".")), F.lower(F.substring_index("ref", ".", 1))))
    fitting = F.expr("CASE WHEN alias IS NULL THEN sources ELSE filter(sources, s -> lower(s.alias) = alias) END")
    bound = (named.withColumn("fitting", fitting)
             .select(*keys, "database_name", "scope", "branch", "pos", "name", "column", (F.size("fitting") > 1).alias("open"), F.explode_outer("fitting").alias("s"))
             .filter("s is not null"))

    with_names = scoped.filter("scope <> ''").select(*keys, F.col("scope").alias("source")).distinct()
    bound = bound.withColumn("source", F.col("s.source")).join(with_names.withColumn("inner", F.lit(True)), [*keys, "source"], "left")
    table = F.when(F.contains("source", F.lit(".")), F.col("source")).otherwise(F.concat_ws(".", "database_name", "source"))
    edges = cut(bound.select(*keys, "scope", "branch", "pos", "name", "open", "column", F.when(F.col("inner"), F.col("source")).alias("child"),
                             F.when(F.col("inner").isNull(), F.concat_ws(".", table, "column")).alias("base")))

    outputs = edges.select(*keys, F.col("scope").alias("child"), F.col("name").alias("column")).distinct()
    known = meta_columns.select(F.lower(F.concat_ws(".", "database_name", "table_name", "column_name")).alias("_key"))
    guesses = edges.filter("open")
    sure = (edges.filter("not open")
            .unionByName(guesses.filter("child is not null").join(outputs, [*keys, "child", "column"], "left_semi"))
            .unionByName(lookup_join(guesses.filter("child is null").withColumn("_key", F.lower("base")), known, ["_key"], "left_semi").drop("_key")))

    lines = sure.select(*keys, "scope", "branch", "pos", "name", "column", "child", "base")
    inner = lines.filter("scope <> ''").select(*keys, F.col("scope").alias("child"), F.col("name").alias("column"), F.col("column").alias("n_column"), F.col("child").alias("n_child"), F.col("base").alias("n_base"))
    frontier = lines.filter("scope = ''").drop("scope", "name").withColumn("seen", F.array().cast("array<string>"))
    traced = frontier.filter("base is not null").drop("seen")
    while True:  # a WITH query that turns up again on its own way ends it
        frontier = cut(frontier.filter("child is not null and not array_contains(seen, child)").join(inner, [*keys, "child", "column"])
                       .select(*keys, "branch", "pos", F.col("n_column").alias("column"), F.col("n_child").alias("child"), F.col("n_base").alias("base"),
                               F.array_append("seen", F.col("child")).alias("seen")))
        if frontier.isEmpty():
            break
        traced = traced.unionByName(frontier.filter("base is not null").drop("seen"))

    usable = F.when(F.col("name") != "", F.col("branch"))
    to_names = items.filter("scope = ''").groupBy(*keys, "pos").agg(F.coalesce(F.min_by("name", usable), F.lit("")).alias("to_name"))
    targets = refs.select(*keys, F.explode_outer("outputs").alias("to_table")).filter("to_table is not null")
    return (traced.select(*keys, "pos", F.col("base").alias("source")).distinct()
            .join(to_names, [*keys, "pos"]).join(targets, keys).select(*keys, "to_table", "pos", "to_name", "source"))
