"""Column lines from statement texts, at any nesting of queries.

A statement becomes an array of tokens in its own row. The prefix sum of parentheses
is the depth at every token; a query begins at an opening parenthesis before SELECT,
WITH or FROM and ends where the depth falls again. A token belongs to the innermost
query around it, and to the clause whose keyword stands last before it at the depth of
that query. Parentheses around joins add no depth. From there on all is rows: sources,
select items and conditions per query and branch (of a UNION, or of a multi-insert).

Queries are resolved from the inside out, one round per height: a query's height is one
more than that of the queries it reads, WITH queries included. Columns go by alias,
bare ones to the only source or to those that are known to have such a column, stars
are written out from metadata or from the query they stand for. An alias that a query
does not know may be one of the query around it: a table or a WITH query; columns of
its queries in FROM stay as they are written there.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.columns import SPECIAL_JOIN_NAMES, SQL_WORDS
from tracewell.operators.skew import lookup_join, sorted_join
from tracewell.operators.statements import LITERAL
from tracewell.storage import keep

# Fixed words.
CLAUSES = ("select", "from", "where", "on", "join", "group", "order", "having", "sort", "cluster", "distribute", "limit", "lateral", "union", "insert", "create", "with", "using", "window")
JOIN_WORDS = ("left", "right", "full", "inner", "cross")
WORDS = (*SQL_WORDS, *CLAUSES, "cluster", "distribute", "insert", "into", "interval", "overwrite", "table", "values", "window")
FRAME = ("rows", "range", "unbounded", "preceding", "following", "current", "row")
TOKEN = LITERAL + r"|\$\{[^}]*\}|[A-Za-z_$][\w$]*(?:\.[\w$]+)*(?:\.\*)?|\d[\w.]*|[(),*\[\]]|[^\s\w(),*\[\]'\"$]+"
KEYS = ["job_id", "stmt_no"]


def _in(what: str, words: tuple[str, ...]) -> str:
    return f"{what} IN ({', '.join(repr(w) for w in words)})"


def token_rows(statements: DataFrame) -> DataFrame:
    """``statements`` (keys, database_name, stmt) with their token, scope and source arrays in the row."""
    steps = [
        ("tok", None),
        ("low", "transform(tok, t -> lower(t))"),
        ("depth", "aggregate(tok, named_struct('at', 0, 'out', CAST(array() AS ARRAY<INT>)), (a, t) -> named_struct("
                  "'at', a.at + CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, 'out', array_append(a.out, a.at + CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)), a -> a.out)"),
        ("opens", "filter(sequence(0, size(tok)), p -> get(tok, p) = '(')"),
        ("parens", "transform(opens, p -> named_struct('open', p, 'close', coalesce(get(filter(sequence(p + 1, size(tok)), j -> get(depth, j) < get(depth, p)), 0), size(tok)), 'base', get(depth, p),"
                   " 'query', coalesce(get(low, p + 1) IN ('select', 'with', 'from'), false), 'joined', coalesce(get(low, p - 1) IN ('from', 'join'), false)))"),
        ("scopes", "concat(array(named_struct('open', -1, 'close', size(tok), 'base', 0)), transform(filter(parens, s -> s.query), s -> named_struct('open', s.open, 'close', s.close, 'base', s.base)))"),
        ("placed", "transform(sequence(0, size(tok) - 1), p -> named_struct('p', p, 't', get(tok, p), 'l', get(low, p), 'own', try_element_at(filter(scopes, s -> s.open < p AND p < s.close), -1),"
                   " 'flat', size(filter(parens, s -> s.joined AND NOT s.query AND s.open <= p AND p < s.close))))"),
        ("leveled", "transform(placed, x -> named_struct('p', x.p, 't', x.t, 'l', x.l, 'scope', x.own.open, 'rel', get(depth, x.p) - x.own.base"
                    " - (x.flat - size(filter(parens, s -> s.joined AND NOT s.query AND s.open < x.own.open AND x.own.open < s.close)))))"),
        ("words", f"filter(leveled, x -> x.rel = 0 AND ({_in('x.l', CLAUSES)} OR {_in('x.l', JOIN_WORDS)} AND get(low, x.p + 1) IN ('join', 'outer', 'semi', 'anti')))"),
        ("commas", "filter(leveled, x -> x.rel = 0 AND x.t = ',')"),
        ("full", "transform(leveled, x -> named_struct('p', x.p, 't', x.t, 'l', x.l, 'scope', x.scope, 'rel', x.rel, 'clause', try_element_at(filter(words, k -> k.scope = x.scope AND k.p <= x.p), -1),"
                 " 'branch', size(filter(words, k -> k.scope = x.scope AND k.p <= x.p AND k.l IN ('union', 'insert'))),"
                 " 'prv', coalesce(get(low, x.p - 1), ''), 'prv2', coalesce(get(low, x.p - 2), ''), 'nxt', coalesce(get(low, x.p + 1), ''),"
                 " 'query', x.t = '(' AND coalesce(get(low, x.p + 1) IN ('select', 'with', 'from'), false),"
                 " 'seam', exists(parens, s -> s.joined AND NOT s.query AND (s.open = x.p OR s.close = x.p))))"),
        ("withs", "transform(filter(full, x -> x.query AND x.clause.l = 'with' AND x.prv = 'as'), x -> named_struct('open', x.p, 'name', x.prv2, 'close', get(filter(scopes, s -> s.open = x.p), 0).close))"),
        ("sources", "transform(filter(full, x -> x.clause.l IN ('from', 'join') AND (x.prv IN ('from', 'join') OR x.prv = ',' AND x.rel = 0 OR x.prv = '(' AND x.prv2 IN ('from', 'join'))"
                    f" AND (x.query OR x.t RLIKE '^[A-Za-z_$]' AND x.nxt <> '(' AND NOT {_in('x.l', WORDS)})), x -> named_struct('p', x.p, 'scope', x.scope, 'branch', x.branch,"
                    " 'name', CASE WHEN x.query THEN '' ELSE x.t END, 'child', CASE WHEN x.query THEN x.p ELSE try_element_at(filter(withs, w -> w.name = x.l AND w.close < x.p), -1).open END,"
                    " 'after', CASE WHEN x.query THEN get(filter(scopes, s -> s.open = x.p), 0).close + 1 ELSE x.p + 1 END))"),
        ("named", "transform(sources, s -> named_struct('p', s.p, 'scope', s.scope, 'branch', s.branch, 'name', s.name, 'child', s.child, 'alias', lower(CASE WHEN get(low, s.after) = 'as' THEN get(tok, s.after + 1)"
                  f" WHEN get(tok, s.after) RLIKE '^[A-Za-z_]\\\\w*$' AND NOT {_in('get(low, s.after)', WORDS)} THEN get(tok, s.after) ELSE substring_index(s.name, '.', -1) END)))"),
        ("parents", "transform(scopes, s -> named_struct('close', s.close, 'open', s.open, 'parent', array_max(transform(filter(scopes, o -> o.open < s.open AND s.close < o.close), o -> o.open))))"),
        ("heights", "aggregate(array_sort(parents), CAST(map() AS MAP<INT, INT>), (m, s) -> map_concat(m, map(s.open, 1 + coalesce(array_max(transform(array_union("
                    "transform(filter(parents, c -> c.parent = s.open), c -> c.open), transform(filter(named, n -> n.scope IN (s.open, s.parent) AND n.child <> s.open), n -> n.child)), d -> coalesce(try_element_at(m, d), -1))), -1))))"),
    ]
    rows = statements.filter(F.rlike("stmt", F.lit(r"(?i)\bselect\b"))).select(
        *KEYS, "database_name", F.regexp_extract_all(F.replace("stmt", F.lit("`"), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("tok"))
    for name, text in steps[1:]:
        rows = rows.withColumn(name, F.expr(text))
    return rows.select(*KEYS, "database_name", "low", "full", "commas", "words", "named", "scopes", "heights")


def expressions(rows: DataFrame) -> DataFrame:
    """(keys, scope, height, branch, kind, eid, toks): select items and conditions with their tokens."""
    flat = rows.select(*KEYS, "low", "words", "heights", "commas", F.explode("full").alias("x")).filter(
        "x.clause.l IN ('select', 'where', 'on') AND x.p > x.clause.p AND NOT (x.t = ',' AND x.rel = 0 AND x.clause.l = 'select')"
        " AND NOT (x.l IN ('distinct', 'all') AND x.prv = 'select') AND NOT x.seam")
    item = F.expr("CASE WHEN x.clause.l = 'select' THEN size(filter(commas, c -> c.scope = x.scope AND c.p < x.p AND c.p > x.clause.p)) ELSE x.clause.p END")
    joined = F.expr("try_element_at(filter(words, k -> k.scope = x.scope AND k.p < x.clause.p AND k.l = 'join'), -1).p")
    flat = flat.withColumn("q", joined).withColumn("kind", F.expr(
        "CASE x.clause.l WHEN 'on' THEN concat(CASE WHEN get(low, q - 1) IN ('left', 'right', 'full', 'inner', 'cross', 'outer', 'semi', 'anti') THEN"
        " concat(CASE WHEN get(low, q - 1) IN ('outer', 'semi', 'anti') THEN get(low, q - 2) ELSE '' END, get(low, q - 1)) ELSE '' END, 'join') ELSE x.clause.l END"))
    token = F.struct(F.col("x.p").alias("p"), F.col("x.t").alias("t"), F.col("x.l").alias("l"), F.col("x.prv").alias("prv"), F.col("x.nxt").alias("nxt"), F.col("x.rel").alias("rel"), F.col("x.query").alias("query"))
    return flat.groupBy(*KEYS, F.col("x.scope").alias("scope"), F.try_element_at("heights", F.col("x.scope")).alias("height"), F.col("x.branch").alias("branch"), "kind", item.alias("eid")).agg(
        F.array_sort(F.collect_list(token)).alias("toks"))  # of one expression


def aliased(exprs: DataFrame) -> DataFrame:
    """Expressions with ``name``, tokens without the alias."""
    last, before = F.element_at("toks", -1), F.try_element_at("toks", F.lit(-2))
    plain_name = last["t"].rlike(r"^[A-Za-z_]\w*$") & ~last["l"].isin(*WORDS)
    is_item = F.col("kind") == "select"
    by_as = is_item & (F.size("toks") > 2) & (before["l"] == "as") & (last["rel"] == 0)
    by_space = is_item & (F.size("toks") > 1) & plain_name & (before["t"].rlike(r"""^[\w$.]+$|^[)\]]$|^['"]""")) & (~before["l"].isin(*WORDS) | (before["l"] == "end")) & (last["rel"] == 0)
    cut_off = F.when(F.coalesce(by_as, F.lit(False)), 2).when(F.coalesce(by_space, F.lit(False)), 1).otherwise(0)
    own = F.when(F.col("cut_off") > 0, last["t"]).when((F.size("toks") == 1) & last["t"].rlike(r"^[A-Za-z_]") & ~last["t"].endswith(".*"), F.substring_index(last["t"], ".", -1)).otherwise("")
    return exprs.withColumn("cut_off", cut_off).withColumn("name", F.when(is_item, own).otherwise("")).withColumn(
        "toks", F.slice("toks", 1, F.size("toks") - F.col("cut_off"))).drop("cut_off").withColumn(
        "star", is_item & (F.size("toks") == 1) & F.element_at("toks", 1)["t"].rlike(r"(^|\.)\*$"))


def column_tokens(exprs: DataFrame) -> DataFrame:
    """(keys, scope, height, branch, kind, eid, p, ref, child): the columns, and the queries, that an expression names."""
    over = F.exists("toks", lambda x: x["l"] == "over")
    rows = exprs.filter("NOT star").select(*KEYS, "scope", "height", "branch", "kind", "eid", over.alias("over"), F.explode("toks").alias("x"))
    column = (F.col("x.t").rlike(r"^[A-Za-z_$](?!\{)") & (F.col("x.nxt") != "(") & ~F.col("x.l").isin(*WORDS) & ~((F.col("x.prv") == "as") & (F.col("x.rel") > 0))
              & ~((F.col("x.nxt") == "from") & (F.col("x.rel") > 0)) & ~(F.col("over") & F.col("x.l").isin(*FRAME)) & ~(F.col("x.l").isin("date", "timestamp") & F.col("x.nxt").rlike("^['\"]"))
              & ~(F.col("x.prv").rlike(r"^\d") & F.col("x.l").isin("day", "days", "month", "months", "year", "years", "hour", "hours", "minute", "minutes", "second", "seconds")))
    kept = rows.withColumn("child", F.when(F.col("x.query"), F.col("x.p"))).filter(column | F.col("x.query"))
    return kept.select(*KEYS, "scope", "height", "branch", "kind", "eid", F.col("x.p").alias("p"), F.when(F.col("child").isNull(), F.col("x.t")).alias("ref"), "child")


def tidy(text: Column) -> Column:
    """Tokens with a blank between them as one writes them."""
    for pattern, left in ((r"\s*([\[\]),])", "$1"), (r"([\[(,])\s+", "$1"), (r"\s+([(\[])", "$1"), (r"(?i)(^|[\s(])(in|and|or|not|on|then|else|when|between|exists|<>|[-=<>+*/%]+)\(", "$1$2 ("), (r"\)(?=[\w'\"])", ") ")):
        text = F.regexp_replace(text, pattern, left)
    return text


def trace_lines(refs: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """Column lines of every statement: (job_id, stmt_no, to_table, pos, to_name, expr, sources, conditions).

    ``refs`` comes from ``statements.table_refs``; ``to_table`` is null where a statement writes none. ``sources`` are sorted
    ``database.table.column``; a star of a table without metadata stays ``database.table.*``. ``expr`` is the item with its columns
    in full, branches of a UNION joined with ``&``. ``conditions`` hold WHERE and JOIN texts of all queries of the statement.
    """
    rows = keep(token_rows(refs))
    if rows.isEmpty():
        return empty_lines(refs)
    sources = rows.select(*KEYS, "database_name", F.inline("named")).withColumn("table", F.when(F.col("child").isNull(), F.when(
        F.contains("name", F.lit(".")), F.col("name")).otherwise(F.concat_ws(".", "database_name", "name"))))
    sources = keep(sources.select(*KEYS, "scope", F.col("branch").alias("s_branch"), F.col("p").alias("place"), "table", F.col("child").alias("s_child"), "alias"))
    exprs = keep(aliased(expressions(rows)))
    columns = meta_columns if "ordinal" in meta_columns.columns else meta_columns.withColumn("ordinal", F.lit(0))
    known = columns.select(F.lower(F.concat_ws(".", "database_name", "table_name")).alias("_table"), F.lower("column_name").alias("_column"), "column_name", "ordinal").distinct()

    # sources of a branch: its own, else those before the first INSERT
    with_own = sources.select(*KEYS, "scope", F.col("s_branch").alias("branch"), F.lit(True).alias("own")).distinct()
    at = sorted_join(exprs.select(*KEYS, "scope", "height", "branch").distinct(), with_own, [*KEYS, "scope", "branch"], "left")
    seen = keep(sorted_join(at, sources, [*KEYS, "scope"]).filter("own AND s_branch = branch OR own IS NULL AND s_branch = 0").drop("own", "s_branch"))
    named = keep(column_tokens(exprs))

    # a reference and the sources it may mean
    parts = F.split(F.lower("ref"), r"\.")
    alias_hit = (F.size("parts") > 1) & (F.get("parts", F.lit(0)) == F.col("alias"))
    table_hit = (F.size("parts") > 2) & (F.concat_ws(".", F.get("parts", F.lit(0)), F.get("parts", F.lit(1))) == F.lower("table"))
    column = F.when(F.size("parts") == 1, F.col("ref")).when(alias_hit, F.get(F.split("ref", r"\."), F.lit(1))).when(table_hit, F.get(F.split("ref", r"\."), F.lit(2)))
    plain = named.filter("child IS NULL").withColumn("parts", parts)
    spot = [*KEYS, "scope", "branch", "kind", "eid", "p"]
    own_hits = sorted_join(plain, seen.drop("height"), [*KEYS, "scope", "branch"]).withColumn("column", column).filter("column IS NOT NULL")
    up = rows.select(*KEYS, F.explode("scopes").alias("s"), "scopes").select(*KEYS, F.col("s.open").alias("scope"), F.expr(
        "array_max(transform(filter(scopes, o -> o.open < s.open AND s.close < o.close), o -> o.open))").alias("outer_scope")).filter("outer_scope IS NOT NULL")
    left_over = sorted_join(sorted_join(plain.filter(F.size("parts") > 1), own_hits.select(*spot).distinct(), spot, "left_anti"), up, [*KEYS, "scope"])
    outer = seen.drop("height", "branch").withColumnRenamed("scope", "outer_scope").distinct()
    outer_hits = sorted_join(left_over, outer, [*KEYS, "outer_scope"]).withColumn("column", column).filter("column IS NOT NULL").drop("outer_scope")
    hits = own_hits.select(*spot, "height", "table", "s_child", "column").unionByName(outer_hits.select(*spot, "height", "table", "s_child", "column"))
    hits = hits.withColumn("open", F.count(F.lit(1)).over(Window.partitionBy(*spot)) > 1)
    base = hits.filter("s_child IS NULL").withColumn("_table", F.lower("table")).withColumn("_column", F.lower("column"))
    sure = base.filter("NOT open").unionByName(lookup_join(base.filter("open"), known.select("_table", "_column").distinct(), ["_table", "_column"], "left_semi"))
    sure = keep(sure.select(*spot, "height", F.concat_ws(".", "table", "column").alias("source")))
    inner = keep(hits.filter("s_child IS NOT NULL").select(*spot, "height", F.col("s_child").alias("from_scope"), F.lower("column").alias("key"))
                .unionByName(named.filter("child IS NOT NULL").select(*spot, "height", F.col("child").alias("from_scope"), F.lit(None).cast("string").alias("key"))))

    starred = exprs.filter("star").select(*KEYS, "scope", "height", "branch", "eid", F.lower(F.substring_index(F.element_at("toks", 1)["t"], ".*", 1)).alias("star_of"))
    stars = sorted_join(starred, seen.drop("height"), [*KEYS, "scope", "branch"]).filter("star_of = '*' OR star_of = alias OR star_of = lower(table)")
    table_stars = lookup_join(stars.filter("s_child IS NULL").withColumn("_table", F.lower("table")), known.select("_table", "column_name", "ordinal"), ["_table"], "left")
    table_stars = keep(table_stars.select(*KEYS, "scope", "height", "branch", "eid", "place", F.coalesce("ordinal", F.lit(0)).alias("sub"), F.coalesce("column_name", F.lit("")).alias("name"),
                                         F.array(F.concat_ws(".", "table", F.coalesce("column_name", F.lit("*")))).alias("sources")))
    query_stars = keep(stars.filter("s_child IS NOT NULL").select(*KEYS, "scope", "height", "branch", "eid", "place", F.col("s_child").alias("from_scope")))

    targets = rows.select(*KEYS, "database_name", F.explode("full").alias("x")).filter(
        f"x.scope = -1 AND x.clause.l IN ('insert', 'create') AND x.prv IN ('table', 'into', 'overwrite', 'exists') AND x.t RLIKE '^[A-Za-z_$]' AND NOT {_in('x.l', (*WORDS, 'if', 'directory', 'local'))}")
    targets = targets.select(*KEYS, F.col("x.branch").alias("t_branch"), F.when(F.contains("x.t", F.lit(".")), F.col("x.t")).otherwise(F.concat_ws(".", "database_name", "x.t")).alias("to_table"))
    branches = sorted_join(exprs.filter("scope = -1 AND kind = 'select'").select(*KEYS, "branch").distinct(), targets, KEYS, "left").filter("t_branch IS NULL OR t_branch <= branch")
    branches = keep(branches.groupBy(*KEYS, "branch").agg(F.max_by("to_table", "t_branch").alias("to_table")))

    highest = exprs.agg(F.max("height")).first()[0]
    outs, texts = None, []
    for height in range(highest + 1):
        here = sure.filter(F.col("height") == height).select(*spot, "source")
        items = table_stars.filter(F.col("height") == height).drop("height")
        if outs is not None:
            asked = inner.filter(F.col("height") == height).drop("height")
            found = sorted_join(asked, outs.select(*KEYS, F.col("scope").alias("from_scope"), F.lower("name").alias("_name"), "sources"), [*KEYS, "from_scope"]).filter("key IS NULL OR key = _name")
            here = here.unionByName(found.select(*spot, F.explode("sources").alias("source")))
            wide = sorted_join(query_stars.filter(F.col("height") == height), outs.select(*KEYS, F.col("scope").alias("from_scope"), F.col("pos").alias("sub"), "name", "sources"), [*KEYS, "from_scope"])
            items = items.unionByName(wide.select(*items.columns))
        by_token = here.groupBy(*spot).agg(F.array_sort(F.collect_set("source")).alias("sources"))
        by_expr = by_token.groupBy(*spot[:-1]).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
                                                   F.map_from_entries(F.collect_list(F.struct("p", F.array_join("sources", "&")))).alias("said"))
        none = F.array().cast("array<string>")
        whole = sorted_join(exprs.filter((F.col("height") == height) & ~F.col("star")), by_expr, spot[:-1], "left").select(
            *KEYS, "scope", "branch", "kind", "eid", "name", F.coalesce("sources", none).alias("sources"),
            tidy(F.array_join(F.transform("toks", lambda x: F.coalesce(F.concat(F.when(x["query"], "(").otherwise(""), F.try_element_at("said", x["p"])), x["t"])), " ")).alias("text"))
        whole = keep(whole)
        texts.append(whole.filter("kind <> 'select'").select(*KEYS, "kind", "text"))
        items = items.withColumn("text", F.get("sources", F.lit(0))).unionByName(whole.filter("kind = 'select'").select(
            *KEYS, "scope", "branch", "eid", F.lit(0).alias("place"), F.lit(0).alias("sub"), "name", "sources", "text"))
        numbered = items.withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS, "scope", "branch").orderBy("eid", "place", "sub")) - 1)
        placed = sorted_join(numbered, branches.withColumn("scope", F.lit(-1)), [*KEYS, "scope", "branch"], "left")
        merged = placed.groupBy(*KEYS, "scope", "to_table", "pos").agg(F.array_sort(F.collect_list(F.struct("branch", "name", "sources", "text"))).alias("parts"))  # branches
        now = keep(merged.select(*KEYS, "scope", "to_table", "pos", F.coalesce(F.get(F.filter("parts", lambda b: b["name"] != ""), F.lit(0))["name"], F.lit("")).alias("name"),
                                F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda b: b["sources"])))).alias("sources"),
                                F.array_join(F.transform("parts", lambda b: b["text"]), "&").alias("expr")))
        outs = now if outs is None else outs.unionByName(now)

    label = F.col("kind")
    for spelling, name in SPECIAL_JOIN_NAMES.items():
        label = F.when(F.col("kind") == spelling, F.lit(name)).otherwise(label)
    conditions = texts[0]
    for more in texts[1:]:
        conditions = conditions.unionByName(more)
    conditions = conditions.select(*KEYS, F.concat(F.upper(label), F.lit(":"), "text").alias("cond")).groupBy(*KEYS).agg(F.array_sort(F.collect_set("cond")).alias("conditions"))
    lines = sorted_join(outs.filter("scope = -1"), conditions, KEYS, "left")
    return lines.select(*KEYS, "to_table", "pos", F.col("name").alias("to_name"), "expr", "sources", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"))


def empty_lines(refs: DataFrame) -> DataFrame:
    """No lines, with the columns that lines have."""
    none = F.array().cast("array<string>")
    return refs.limit(0).select(*KEYS, F.lit("").alias("to_table"), F.lit(0).alias("pos"), F.lit("").alias("to_name"), F.lit("").alias("expr"), none.alias("sources"), none.alias("conditions"))
