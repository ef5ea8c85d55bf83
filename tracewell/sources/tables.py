"""Named Parquet tables of one data folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one named table."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, *names: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text with the named tables and extra frames visible as views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(text)


def columns_of(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, str, str]]:
    """(table, ordinal, column, type) of every table, from the file footers."""
    return [
        (name, ordinal, field.name, field.dataType.simpleString())
        for name in TABLES
        for ordinal, field in enumerate(table(spark, sf_dir, name).schema.fields, start=1)
    ]


TASK_ROWS = 25_000  # of work that is heavy per row


def use_all_cores(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows of a scan in at least as many partitions as there are cores, and in more where one would get over ``task_rows`` rows.

    A small file is one partition; work that is heavy per row would then run in
    one task. The rows are counted, for a scan from its footers. Inputs of enough
    partitions stay unshuffled.
    Only for frames without a shuffle of their own.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
