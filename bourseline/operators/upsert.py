"""Copy-on-write merges: each returns the table's next version as a frame to be written.

Plain Parquet has no MERGE; a writer overwrites the touched partitions with
the result.  Keys compare null-safely where a key part may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Target and those new rows whose key it lacks; of new rows with one key the first stays."""
    fresh = first_per_key(new, keys, order)
    return target.unionByName(fresh.join(target, _same(fresh, target, keys), "left_anti"))


def newest_wins(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for every key: the new one, else the old; of rows with one key the first in order."""
    both = target.withColumn("age_", F.lit(1)).unionByName(new.withColumn("age_", F.lit(0)))
    return first_per_key(both, keys, [F.col("age_"), *order]).drop("age_")


def merge_filled(target: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str]) -> DataFrame:
    """Full merge: the new value where there is one, but the old value of ``keep_old`` columns where that is set."""
    new = new.select(*[F.col(c).alias(f"{c}__new") for c in new.columns])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__new")) for k in keys])
    rows = target.withColumn("old_", F.lit(True)).join(new.withColumn("new_", F.lit(True)), on, "full")
    out = []
    for c in target.columns:
        other = F.col(f"{c}__new")
        if c in keys:
            out.append(F.when(F.col("old_"), F.col(c)).otherwise(other).alias(c))
        else:
            out.append((F.coalesce(F.col(c), other) if c in keep_old else F.coalesce(other, F.col(c))).alias(c))
    return rows.select(*out)


def replace_keys(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target without the keys that the new rows have, and the new rows (delete and insert)."""
    gone = new.select(*keys).distinct()
    return target.join(gone, _same(target, gone, keys), "left_anti").unionByName(new)


def updated(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target with the columns of matching changes where those are not null."""
    side = changes.select(*[F.col(k).alias(f"{k}__new") for k in keys], *[F.col(c).alias(f"{c}__new") for c in columns])
    on = reduce(lambda x, y: x & y, [target[k].eqNullSafe(side[f"{k}__new"]) for k in keys])
    return target.join(side, on, "left").select(*[F.coalesce(side[f"{c}__new"], target[c]).alias(c) if c in columns else target[c] for c in target.columns])


def run_record(spark, run_id: str, counts: dict[str, int], status: str) -> DataFrame:
    """One row for the run log."""
    names = sorted(counts)
    return spark.createDataFrame([(run_id, status, *[int(counts[n]) for n in names])], ", ".join(["run_id string", "status string", *[f"{n} long" for n in names]]))


def checked(rows: DataFrame, **tests: Column) -> DataFrame:
    """Raise ValueError with the number of rows that fail each test; one small aggregate."""
    failed = rows.agg(*[F.count_if(~F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()]).first()
    bad = {n: failed[n] for n in tests if failed[n]}
    if bad:
        raise ValueError(f"rows that fail: {bad}")
    return rows
