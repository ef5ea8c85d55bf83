"""Relation rows of scripts, from their texts, kept up to date.

A store is a folder below the shared one with two tables: ``scripts``, the digests of
all scripts that have ever been traced, and ``lines``, their column lines. A refresh
traces only scripts whose digest the store lacks, each text once however many jobs hold
it, and appends. Lines of texts that no job holds any more stay in the store and are
found by no join, so they are retracted; a text that comes back costs nothing.

A script's lines depend on its text and, for bare columns and stars, on metadata. A
digest therefore holds a version that the caller gives: with new metadata, give a new one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.columns import relation_rows
from tracewell.operators.scopes import trace_lines
from tracewell.operators.skew import sorted_join
from tracewell.operators.statements import table_refs
from tracewell.sources.tables import use_all_cores
from tracewell.storage import keep

LINES = "digest string, stmt_no int, to_table string, pos int, to_name string, expr string, sources array<string>, conditions array<string>"


def with_digest(jobs: DataFrame, version: str = "") -> DataFrame:
    return jobs.withColumn("digest", F.sha2(F.concat(F.lit(f"{version}\n"), F.coalesce("script", F.lit(""))), 256))


def stored(jobs: DataFrame, store: str, part: str) -> DataFrame:
    """A table of the store; empty where nothing has been written."""
    spark, schema = jobs.sparkSession, LINES if part == "lines" else "digest string"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{part}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(f"{store}/{part}")
    return spark.createDataFrame([], schema)


def unseen(jobs: DataFrame, store: str, version: str = "") -> DataFrame:
    """(id, script, digest): one job of each text that the store has not traced."""
    own = with_digest(jobs, version).groupBy("digest").agg(F.min("id").alias("id"), F.min("script").alias("script"))
    return sorted_join(own, stored(jobs, store, "scripts"), ["digest"], "left_anti")


def refresh(jobs: DataFrame, meta_columns: DataFrame, store: str, version: str = "") -> DataFrame:
    """Column lines of ``jobs`` (id, script), of which only texts new to the store are traced.

    (job_id, stmt_no, to_table, pos, to_name, expr, sources, conditions). Lines are written before the digests, so a refresh
    that is interrupted between the two traces its texts again, and equal lines are taken once.
    """
    fresh = keep(unseen(jobs, store, version))
    if not fresh.isEmpty():
        lines = trace_lines(table_refs(use_all_cores(fresh)), meta_columns)
        names = fresh.select(F.col("id").alias("job_id"), "digest")
        sorted_join(lines, names, ["job_id"]).select("digest", *(f.split(" ")[0] for f in LINES.split(", ")[1:])).write.mode("append").parquet(f"{store}/lines")
        fresh.select("digest").write.mode("append").parquet(f"{store}/scripts")
    known = stored(jobs, store, "lines").dropDuplicates(["digest", "stmt_no", "to_table", "pos"])
    named = with_digest(jobs, version).select(F.col("id").alias("job_id"), "digest")
    return sorted_join(named, known, ["digest"]).drop("digest")


def relations(lines: DataFrame, meta_columns: DataFrame) -> DataFrame:
    """(job_id, stmt_no, src, dst, from_column_id, from_table_id, column_id, table_id, condition): a row per line and source with a target."""
    edges = lines.filter("to_table IS NOT NULL AND to_name <> ''").select(
        "job_id", "stmt_no", F.explode("sources").alias("src"), F.concat_ws(".", "to_table", "to_name").alias("dst"),
        F.translate(F.array_join("conditions", ", "), "'", "~").alias("condition"))
    return relation_rows(edges, meta_columns)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that came and went between two states of lines: (job_id, src, dst, change)."""
    def edges(lines: DataFrame) -> DataFrame:
        return lines.filter("to_table IS NOT NULL").select("job_id", F.explode("sources").alias("src"), F.concat_ws(".", "to_table", "to_name").alias("dst")).distinct()

    old, new = edges(before), edges(after)
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))
