"""Shared storage: where lineage is cut and where file sinks write.

Everything lands below the folder the cluster names in ``spark.checkpoint.dir``,
so that lost executors can be replaced. Only a local session without that
setting gets a folder of its own.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    context = spark.sparkContext
    configured = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="tracewell-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tracewell/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame on reliable storage and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """Write a large frame as a table below the shared folder and go on from there.

    Cuts lineage like ``cut``, in columnar and compressed form, so that later
    steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
