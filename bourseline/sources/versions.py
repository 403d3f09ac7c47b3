"""Several tables changed in one commit: a manifest names the stored version of every table and is written last.

Tables are plain Parquet folders that are never changed.  Readers see the
tables of one manifest; a writer that fails before the manifest, or meets
another commit of the same base, leaves all tables as they were.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed since the base version was read."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def latest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the newest version and the path of every table in it; (0, {}) before the first commit."""
    fs, where = _fs(spark, f"{root}/_versions")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}
    found = max(numbers)
    lines = spark.read.text(f"{root}/_versions/{found:020d}.json").collect()
    return found, json.loads("\n".join(r[0] for r in lines))


def read(spark: SparkSession, root: str, version: dict[str, str], table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{version[table]}")


def commit(spark: SparkSession, root: str, base: int, tables: dict[str, DataFrame]) -> int:
    """Write these tables and make them the version after ``base``; tables that are not named keep theirs.

    Conflict is raised, and what was written is removed, if ``base`` is no
    longer the newest version.  The manifest is a whole file that is renamed
    without overwriting, so of two writers one wins.
    """
    newest, paths = latest(spark, root)
    if newest != base:
        raise Conflict(f"version {newest} is newer than {base}")
    fresh = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{root}/{fresh[name]}")
        _publish(spark, root, base + 1, json.dumps(paths | fresh))
    except BaseException:
        for path in fresh.values():
            fs, where = _fs(spark, f"{root}/{path}")
            fs.delete(where, True)
        raise
    return base + 1


def _publish(spark: SparkSession, root: str, version: int, text: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, draft = _fs(spark, f"{root}/_versions/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri()).rename(draft, hadoop.Path(f"{root}/_versions/{version:020d}.json"), how)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"version {version} was committed by another writer") from None
        raise
