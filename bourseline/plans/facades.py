"""Market-shaped views of the supplied tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each security and session: open, high, low, close, volume, turnover."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("trade_date"), unit.alias("unit"), order.alias("at"), "l_quantity", "l_extendedprice")
    return rows.groupBy("security_id", "trade_date").agg(
        F.min_by("unit", "at").alias("open"),
        F.max("unit").alias("high"),
        F.min("unit").alias("low"),
        F.max_by("unit", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("turnover"),
    )


BARS = """bars AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS trade_date,
 ARG_MIN(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, MAX(l_extendedprice / l_quantity) AS high,
 MIN(l_extendedprice / l_quantity) AS low, ARG_MAX(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close,
 SUM(l_quantity) AS volume, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS turnover
 FROM lineitem GROUP BY 1, 2)"""


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities with name, symbol, exchange and whether they are active."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    tag = F.when(key % 3 == 0, "BOTH").when(key % 3 == 1, "NSE").otherwise("BSE")
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(key.alias("security_id"), F.upper(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("instrument_name"), F.concat(F.lit("SYM"), key.cast("string")).alias("symbol"), F.col("r_name").alias("exchange_name"), tag.alias("exchange_tag"), (F.col("s_acctbal") >= 0).alias("is_active"))


MASTER = """master AS (SELECT s_suppkey AS security_id, UPPER(REPLACE(s_name, '#', ' ')) AS instrument_name,
 'SYM' || CAST(s_suppkey AS VARCHAR) AS symbol, r_name AS exchange_name,
 CASE WHEN s_suppkey % 3 = 0 THEN 'BOTH' WHEN s_suppkey % 3 = 1 THEN 'NSE' ELSE 'BSE' END AS exchange_tag, s_acctbal >= 0 AS is_active
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with its security, time of publication (exchange wall clock), mapping status and category."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("security_id"))
    orders = table(spark, sf_dir, "orders")
    at = F.expr("o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("MAPPED")
    return orders.join(first, orders["o_orderkey"] == first["l_orderkey"]).select(F.col("o_orderkey").alias("news_id"), "security_id", at.alias("published_at"), status.alias("mapping_status"), F.col("o_orderpriority").alias("category"))


NEWS = """news AS (SELECT o_orderkey AS news_id, MIN(l_suppkey) AS security_id,
 o_orderdate + (o_orderkey % 1440) * INTERVAL '1' MINUTE AS published_at,
 CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'MAPPED' END AS mapping_status, o_orderpriority AS category
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_orderstatus, o_orderpriority)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions with a subject text."""
    kind = F.col("news_id") % 5
    amount = (F.col("news_id") % 17 + 1).cast("string")
    subject = F.when(kind == 0, F.concat(F.lit("Dividend - Rs "), amount, F.lit(" Per Share"))).when(kind == 1, "Bonus 1:1").when(kind == 2, "Rights issue").when(kind == 3, "Buy Back").otherwise("Board Meeting")
    return news(spark, sf_dir).select(F.col("news_id").alias("corporate_action_id"), "security_id", F.col("published_at").cast("date").alias("record_received_date"), subject.alias("subject"))


ACTIONS = """actions AS (SELECT news_id AS corporate_action_id, security_id, CAST(published_at AS DATE) AS record_received_date,
 CASE news_id % 5 WHEN 0 THEN 'Dividend - Rs ' || CAST(news_id % 17 + 1 AS VARCHAR) || ' Per Share' WHEN 1 THEN 'Bonus 1:1'
 WHEN 2 THEN 'Rights issue' WHEN 3 THEN 'Buy Back' ELSE 'Board Meeting' END AS subject FROM news)"""


def with_views(body: str, *views: str) -> str:
    """An oracle statement: the named views in front of a query."""
    return "WITH " + ",\n".join(views) + "\n" + body


def quantized(x: Column, scale: float = 1e4) -> Column:
    """A double cut to a grid in a way that every engine computes alike."""
    return F.floor(x * scale + 0.5) / scale
