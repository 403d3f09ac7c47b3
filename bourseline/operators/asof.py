"""As-of and session-index joins over price series.

Sessions of a series are numbered once; every n-th session after or before a
date is then an equi join on (security, number), with no range scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with ``session``, their number in the security's own order from 1."""
    return bars.withColumn("session", F.row_number().over(Window.partitionBy("security_id").orderBy("trade_date")))


def as_of(events: DataFrame, series: DataFrame, at: str, values: list[str]) -> DataFrame:
    """Events with the values of the last row of the series at or before ``at`` (a date column).

    Both sides are put into one sorted run for each security: one shuffle, one
    sort, no pair of rows is ever formed.  Events without an earlier row get nulls.
    """
    own = events.columns
    left = events.select(F.col("security_id"), F.col(at).alias("on_"), F.lit(1).alias("side_"), F.struct(*own).alias("event_"), *[F.lit(None).cast(series.schema[v].dataType).alias(v) for v in values], F.lit(None).cast("date").alias("base_date"))
    right = series.select("security_id", F.col("trade_date").alias("on_"), F.lit(0).alias("side_"), F.lit(None).cast(left.schema["event_"].dataType).alias("event_"), *values, F.col("trade_date").alias("base_date"))
    run = Window.partitionBy("security_id").orderBy("on_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    marked = right.unionByName(left).withColumn("last_", F.last(F.when(F.col("side_") == 0, F.struct("base_date", *values)), ignorenulls=True).over(run))
    return marked.filter("side_ = 1").select("event_.*", "last_.*")


def forward(events: DataFrame, sessions: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """Events (with ``session``, the base session) and the close ``c<k>`` of the k-th session after it."""
    closes = sessions.select("security_id", F.col("session").alias("s_"), F.col("close").alias("c_"))
    ahead = events.withColumn("k_", F.explode(F.array(*[F.lit(k) for k in steps]))).withColumn("s_", F.col("session") + F.col("k_")).join(closes, ["security_id", "s_"], "left")
    return ahead.groupBy(*events.columns).agg(*[F.max(F.when(F.col("k_") == k, F.col("c_"))).alias(f"c{k}") for k in steps])


def counted_between(events: DataFrame, bars: DataFrame, at: str, days: int) -> DataFrame:
    """Events with ``n_rows``, the security's sessions in the ``days`` days up to ``at``.

    A running count as of the last day minus that before the first day: two
    as-of steps in place of a range join.
    """
    counts = bars.select("security_id", "trade_date").withColumn("seen", F.row_number().over(Window.partitionBy("security_id").orderBy("trade_date")))
    upto = as_of(events, counts, at, ["seen"]).drop("base_date").withColumnRenamed("seen", "upto_")
    before = as_of(upto.withColumn("from_", F.date_sub(F.col(at), days + 1)), counts, "from_", ["seen"]).drop("base_date")
    return before.withColumn("n_rows", (F.coalesce("upto_", F.lit(0)) - F.coalesce("seen", F.lit(0))).cast("long")).drop("from_", "upto_", "seen")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rank_ = 1").drop("rank_")
