"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local session (tests) takes a temporary
    folder; on a cluster that would be a different disk for each executor, so
    it is an error there.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="bourseline-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/bourseline-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    This cuts the lineage with data that outlives an executor, so a lost
    executor never replays the work above it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark clean the shuffles of plans that are out of use."""
    gc.collect()
    for frame in frames:
        if path := getattr(frame, "stored_at", None):
            spark = frame.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            frame.stored_at = None
            spark._jvm.System.gc()


def plain_names(columns: list[str]) -> list[str]:
    """Names without dots and signs, which Arrow functions need: ``text`` stays, others are numbered."""
    return [c if c == "text" else f"c{i}_" for i, c in enumerate(columns)]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Most ids that a broadcast may hold: 8 bytes each.
BROADCAST_IDS = 500_000


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``; ids over a size bound are joined by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
