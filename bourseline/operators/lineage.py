"""Cutting lineage where a loop would grow it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is absent, a local session takes a temporary folder and a cluster fails."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="bourseline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/bourseline-{uuid.uuid4().hex}/{name}"


def cut(rows: DataFrame) -> DataFrame:
    """The frame written to the shared folder, from where a lost executor's work is read again."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def written(rows: DataFrame, name: str) -> DataFrame:
    """The frame as a table of columns in the shared folder: for wide rows of which later steps read some columns each."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
