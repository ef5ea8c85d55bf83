"""Preparing scheduler scripts: settings, macros, shell and Python wrappers.

Everything that depends on one script only is an expression on its row; joins
are needed for the group settings and for included files alone.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.skew import lookup_join
from tracewell.storage import cut

RUN_TYPES = ("hive", "spark")

# Fixed patterns.
DATE_MACRO = r'\$\{zdt\.addDay\((-?\d+)\)\.format\("([^"]*)"\)\}'
OPEN_VARIABLE = r"\$\{[^}]*\}"
HIVE_COMMAND = r'(?m)^[^#\n]*?(?:\b|_)hive\d?\b[^"\n]*?\s-e\s*"((?:[^"\\]++|\\[\s\S])*+)"'
SOURCE_CALL = r"(?m)^\s*source\s+(\S+)"
SHELL_CALL = r"(?m)^\s*sh\s+(?:-\S+\s+)?(\S+)"
SHELL_ASSIGNMENT = r"""(?m)(?:^|[\s;])(\w+)\s*=\s*(?:"((?:[^"\\]++|\\[\s\S])*+)"|'([^']*+)'|`([^`]*+)`|([^\s;"'`=]++))"""
PYTHON_RUN_CALL = r"runHiveCmd\(\s*(\w+)"
PYTHON_SQL_ASSIGNMENT = r'(?m)^\s*(\w+)\s*=\s*"""([\s\S]*?)"""'
PYTHON_VALUE_ASSIGNMENT = r"""(?m)^\s*(\w+)\s*=\s*["']([^"'\n]+)["']"""


def scheduled_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that the scheduler runs on its own with an SQL engine."""
    return jobs.filter(F.col("run_type").isin(*RUN_TYPES) & (F.col("auto") == 1))


def settings_map(configs: str = "configs") -> Column:
    """A JSON object of settings as a map; text that is no object gives none."""
    return F.coalesce(F.from_json(configs, "map<string,string>"), F.create_map().cast("map<string,string>"))


def config_entries(df: DataFrame, owner: str) -> DataFrame:
    """One row per setting of an owner."""
    return df.select(F.col("id").alias(owner), F.explode(settings_map()).alias("key", "value"))


def group_chain(groups: DataFrame) -> DataFrame:
    """(group_id, ancestor_id, distance) up to the root, the group itself at 0.

    Walks the groups only. Groups that were deleted end a chain, a group that
    turns up again in its own chain ends it too.
    """
    live = groups.filter("existed = 1").select("id", "parent")
    parents = live.withColumnRenamed("id", "ancestor_id").withColumnRenamed("parent", "next_id")
    frontier = live.select(
        F.col("id").alias("group_id"), F.col("id").alias("ancestor_id"), F.lit(0).alias("distance"),
        F.array("id").alias("seen"), F.col("parent").alias("next_id"),
    )
    levels = [frontier]
    while True:
        frontier = cut(
            frontier.filter("next_id <> 0 and not array_contains(seen, next_id)")
            .select("group_id", F.col("next_id").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"), "seen")
            .join(parents, "ancestor_id")
            .select("group_id", "ancestor_id", "distance", F.array_append("seen", F.col("ancestor_id")).alias("seen"), "next_id")
        )
        if frontier.isEmpty():
            break
        levels.append(frontier)
    chain = levels[0]
    for level in levels[1:]:
        chain = chain.unionByName(level)
    return chain.select("group_id", "ancestor_id", "distance")


def group_settings(groups: DataFrame) -> DataFrame:
    """(group_id, settings): the nearest value of every key along the chain."""
    own = groups.filter("existed = 1").select(F.col("id").alias("ancestor_id"), F.explode(settings_map()).alias("key", "value"))
    nearest = (
        group_chain(groups).join(own, "ancestor_id")
        .groupBy("group_id", "key").agg(F.min_by("value", "distance").alias("value"), F.min("distance").alias("distance"))
    )
    return nearest.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "key", "value"))).alias("inherited"))


def effective_settings(jobs: DataFrame, groups: DataFrame) -> DataFrame:
    """Jobs with ``settings``: own entries first, then those of the nearest groups."""
    with_groups = lookup_join(jobs, group_settings(groups), ["group_id"], how="left", small=True).withColumn("own", F.map_entries(settings_map()))
    own_keys = F.transform("own", lambda e: e["key"])
    inherited = F.transform(
        F.filter(F.coalesce(F.col("inherited"), F.array().cast("array<struct<distance:int,key:string,value:string>>")),
                 lambda e: ~F.array_contains(own_keys, e["key"])),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return with_groups.withColumn("settings", F.concat("own", inherited)).drop("inherited", "own")


def substitute(script: str = "script", settings: str = "settings") -> Column:
    """Every ``${key}`` replaced literally by its value, in the order of the entries."""
    return F.aggregate(
        settings, F.col(script),
        lambda text, e: F.replace(text, F.concat(F.lit("${"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def unresolved_variables(script: str = "script") -> Column:
    """The ``${..}`` still in a text."""
    return F.array_distinct(F.regexp_extract_all(script, F.lit(OPEN_VARIABLE), F.lit(0)))


def render_dates(script: str, run_time: str) -> Column:
    """Date macros and ``${yesterday}`` written out relative to the run time."""
    macros = F.array_distinct(F.regexp_extract_all(script, F.lit(DATE_MACRO), F.lit(0)))

    def shifted(macro: Column) -> Column:
        days = F.regexp_extract(macro, DATE_MACRO, 1).cast("int")
        moved = F.col(run_time).cast("timestamp_ntz") + F.make_dt_interval(days=days)
        return F.call_function("date_format", moved, F.regexp_extract(macro, DATE_MACRO, 2))

    rendered = F.aggregate(macros, F.col(script), lambda text, macro: F.replace(text, macro, shifted(macro)))
    yesterday = F.date_format(F.date_sub(F.col(run_time).cast("date"), 1), "yyyyMMdd")
    return F.replace(rendered, F.lit("${yesterday}"), yesterday)


def hive_commands(scripts: DataFrame, content: str = "content") -> DataFrame:
    """One row per SQL text handed to ``hive -e`` in a shell script."""
    texts = F.transform(F.regexp_extract_all(content, F.lit(HIVE_COMMAND), F.lit(1)), lambda t: F.replace(t, F.lit('\\"'), F.lit('"')))
    return scripts.filter(F.col("path").endswith("sh")).select(
        "script_id", "path", content, F.posexplode(texts).alias("call_no", "sql_text"))


def _assignments(content: str, pattern: str) -> Column:
    """``name = value`` pairs of a text as an array of structs."""
    return F.arrays_zip(
        F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("value"))


def shell_assignments(content: str) -> Column:
    """Assignments of a shell script: values in double or single quotes, back quotes, or as a bare word."""
    names = F.regexp_extract_all(content, F.lit(SHELL_ASSIGNMENT), F.lit(1))
    values = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), (F.regexp_extract_all(content, F.lit(SHELL_ASSIGNMENT), F.lit(g)) for g in (2, 3, 4, 5)))
    return F.arrays_zip(names.alias("name"), values.alias("value"))


def _fill_shell(text: Column, pairs: Column) -> Column:
    """Whole names only: ``$tbl`` leaves ``$tbl2`` alone."""
    return F.aggregate(pairs, text, lambda acc, p: F.regexp_replace(
        acc, F.concat(F.lit(r"\$(?:\{"), p["name"], F.lit(r"\}|"), p["name"], F.lit(r"\b)")), F.regexp_replace(p["value"], r"([\\$])", r"\\$1")))


def fill_shell_variables(calls: DataFrame, content: str = "content") -> DataFrame:
    """SQL texts with ``$var`` and ``${var}`` filled from the script's assignments.

    Two rounds, for values that hold a variable themselves. ``missing`` lists
    what no assignment gives.
    """
    pairs = shell_assignments(content)
    twice = _fill_shell(_fill_shell(F.col("sql_text"), F.col("pairs")), F.col("pairs"))
    missing = F.regexp_extract_all("filled_sql", F.lit(r"\$\{?\w+\}?"), F.lit(0))
    return (calls.withColumn("pairs", pairs).withColumn("filled_sql", twice).drop("pairs")
            .withColumn("missing", F.array_distinct(missing)))


def python_commands(scripts: DataFrame, content: str = "content") -> DataFrame:
    """SQL of ``runHiveCmd(var, ..)`` calls in Python scripts, ``%(x)s`` filled in.

    Only texts that insert into a table count. A call takes the first
    triple-quoted assignment of its variable.
    """
    called = F.array_distinct(F.regexp_extract_all(content, F.lit(PYTHON_RUN_CALL), F.lit(1)))
    values = _assignments(content, PYTHON_VALUE_ASSIGNMENT)
    fill = F.aggregate("values", F.col("raw_sql"), lambda acc, v: F.replace(
        acc, F.concat(F.lit("%("), v["name"], F.lit(")s")), v["value"]))
    return (
        scripts.filter(F.col("path").endswith("py"))
        .select("script_id", "path", _assignments(content, PYTHON_SQL_ASSIGNMENT).alias("texts"),
                values.alias("values"), F.posexplode(called).alias("call_no", "variable"))
        .withColumn("raw_sql", F.get(F.expr("filter(texts, t -> t.name = variable)"), F.lit(0))["value"])
        .filter(F.lower("raw_sql").contains("insert") & F.lower("raw_sql").contains("table"))
        .select("script_id", "path", "call_no", "variable", fill.alias("sql_text"))
    )


def called_paths(content: str = "content", path: str = "path", pattern: str = SOURCE_CALL) -> Column:
    """Paths of the called files: their names in the folder of the caller."""
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return F.transform(
        F.filter(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda n: F.contains(n, F.lit("."))),
        lambda n: F.concat(folder, F.substring_index(n, "/", -1)))


def inline_sources(scripts: DataFrame, files: DataFrame) -> DataFrame:
    """Shell scripts with the text of the files they source or call with ``sh`` put in front.

    ``files`` holds (path, content). ``n_missing`` counts calls without a file.
    """
    shell = scripts.filter(F.col("path").endswith("sh"))
    both = F.concat(called_paths(), called_paths(pattern=SHELL_CALL))
    calls = shell.select("script_id", F.posexplode(both).alias("call_no", "called"))
    found = lookup_join(calls, files.select(F.col("path").alias("called"), F.col("content").alias("included")), ["called"], "left")
    merged = found.groupBy("script_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_no", "included"))), lambda c: c["included"]), "").alias("included"),
        F.count_if(F.col("included").isNull()).alias("n_missing"))
    return shell.join(merged, "script_id", "left").select(
        "script_id", "path", F.concat(F.coalesce("included", F.lit("")), "content").alias("content"),
        F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"))
