"""Running streams to completion over what has arrived, with results in the shared folder.

Nothing passes through the driver: append streams write files, update and
complete streams write each micro-batch to a folder of its own, which a retried
batch overwrites.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.tables import table
from tracewell.storage import scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def folder_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landing folder as a stream of files."""
    return spark.readStream.schema(schema).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str, delay: str | None = None) -> DataFrame:
    """The events with ``ts`` as an instant, and a watermark when a delay is given."""
    events = table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay) if delay else events


class AppendRun:
    """An append stream into a file sink; can be run again when more files have arrived."""

    def __init__(self, spark: SparkSession, label: str):
        self.path = scratch_path(spark, label)
        self.checkpoint = scratch_path(spark, f"{label}-checkpoint")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process all that is there and return everything written so far."""
        query = (stream.writeStream.outputMode("append").format("parquet").option("path", self.path)
                 .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(self.path)


def run_append(stream: DataFrame, label: str) -> DataFrame:
    return AppendRun(stream.sparkSession, label).run(stream)


def run_batches(stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Every micro-batch of an update or complete stream, with its ``batch_id``."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_foreach(stream, label, mode, keep)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def run_foreach(stream: DataFrame, label: str, mode: str, work: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{label}-checkpoint")
    query = (stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def latest_by_key(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The last value written for every key of an update stream."""
    rest = [c for c in batches.columns if c not in (*keys, "batch_id")]
    last = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return last.select(*keys, "_row.*")


def last_batch(batches: DataFrame) -> DataFrame:
    """The last result a complete stream wrote."""
    newest = batches.agg(F.max("batch_id").alias("batch_id"))
    return batches.join(newest, "batch_id").drop("batch_id")
