"""Identity checks, security classes, groups of news, canonical decisions and life cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import market as M
from ..functions import rules as R
from ..functions import text as T
from ..operators.asof import latest_per_key
from .facades import ACTIONS, BARS, MASTER, NEWS, actions, bars, master, news, quantized, table, with_views
from .registry import query


@query("""SELECT part_key, isin, total % 10 = 0 AS is_valid FROM (SELECT part_key, isin, LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN
 CASE WHEN CAST(d[LEN(d) + 1 - i] AS INT) > 4 THEN 2 * CAST(d[LEN(d) + 1 - i] AS INT) - 9 ELSE 2 * CAST(d[LEN(d) + 1 - i] AS INT) END ELSE CAST(d[LEN(d) + 1 - i] AS INT) END)) AS total FROM (
 SELECT part_key, isin, STRING_SPLIT(REPLACE(REPLACE(REPLACE(isin, 'I', '18'), 'N', '23'), 'E', '14'), '') AS d FROM (SELECT p_partkey AS part_key, 'INE' || LPAD(CAST(p_partkey AS VARCHAR), 9, '0') AS isin FROM part) x) y) z""")  # fmt: skip
def isin_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    isin = F.concat(F.lit("INE"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), isin.alias("isin"), T.isin_valid(isin).alias("is_valid"))


@query("""SELECT l_suppkey AS security_id, MIN(l_shipdate) AS first_seen, MAX(l_shipdate) AS last_seen, COUNT(*) AS occurrences,
 ARG_MAX(l_returnflag, EPOCH(l_shipdate) * 1e9 + l_orderkey * 100 + l_linenumber) AS last_flag FROM lineitem GROUP BY 1""")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date, number of rows and the latest row's flag of every security."""
    order = F.struct("l_shipdate", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("security_id")).agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.count("*").alias("occurrences"), F.max_by("l_returnflag", order).alias("last_flag"))


@query(with_views("""SELECT security_id, CASE WHEN instrument_name LIKE '%ETF%' THEN 'ETF' WHEN security_id % 10 = 9 THEN 'MUTUAL_FUND' WHEN security_id % 10 IN (1, 2) THEN 'BOND'
 WHEN security_id % 10 IN (3, 4) THEN 'EQUITY' WHEN security_id % 10 = 5 THEN 'OTHER' END AS asset_category FROM master""", MASTER))  # fmt: skip
def master_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset categories by the ordered rules; null where none holds."""
    last = F.col("security_id") % 10
    series = F.when(last == 1, "GS").when(last == 2, "N1").when(last == 3, "EQ").when(last == 4, "SM").when(last == 5, "RR")
    isin = F.when(last == 9, "INF000000001")
    return master(spark, sf_dir).select("security_id", R.asset_category(F.col("instrument_name"), F.col("symbol"), series, isin, F.lit(None).cast("string")).alias("asset_category"))


@query(with_views("""SELECT security_id, category, COUNT(*) AS n, MIN(news_id) AS first_news, ARG_MIN(mapping_status, news_id) AS first_status FROM news GROUP BY 1, 2""", NEWS))
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of news by key with their size, first item and its status; no list of members is collected."""
    return news(spark, sf_dir).groupBy("security_id", "category").agg(F.count("*").alias("n"), F.min("news_id").alias("first_news"), F.min_by("mapping_status", "news_id").alias("first_status"))


@query(with_views("""SELECT security_id, COUNT(*) AS total, COUNT(*) = COUNT(*) FILTER (WHERE mapping_status = 'PENDING') AS all_open FROM news GROUP BY 1""", NEWS))
def open_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every item of a group is still open."""
    return news(spark, sf_dir).groupBy("security_id").agg(F.count("*").alias("total"), (F.count("*") == F.count_if(F.col("mapping_status") == "PENDING")).alias("all_open"))


@query(with_views("""SELECT security_id, CASE WHEN strong = 1 AND continuity = 'ESTABLISHED' THEN 'MATCH' WHEN strong > 1 OR continuity = 'PLAUSIBLE' THEN 'REVIEW' ELSE 'NO_CANONICAL_MATCH' END AS decision
 FROM (SELECT security_id, LEAST(COUNT(*) FILTER (WHERE mapping_status = 'PENDING'), 3) % 3 AS strong, CASE security_id % 3 WHEN 0 THEN 'ESTABLISHED' WHEN 1 THEN 'PLAUSIBLE' ELSE 'NONE' END AS continuity FROM news GROUP BY security_id) x""", NEWS))  # fmt: skip
def canonical_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = F.least(F.count_if(F.col("mapping_status") == "PENDING"), F.lit(3)) % 3
    rows = news(spark, sf_dir).groupBy("security_id").agg(strong.alias("strong")).withColumn("continuity", F.when(F.col("security_id") % 3 == 0, "ESTABLISHED").when(F.col("security_id") % 3 == 1, "PLAUSIBLE").otherwise("NONE"))
    return rows.select("security_id", R.canonical_decision(F.col("strong"), F.col("continuity")).alias("decision"))


@query(with_views("""SELECT corporate_action_id, CASE WHEN corporate_action_id % 4 = 0 THEN record_received_date + 10 WHEN corporate_action_id % 4 = 1 THEN record_received_date + 3 ELSE record_received_date END AS life_date,
 CASE WHEN corporate_action_id % 4 = 0 THEN record_received_date + 10 WHEN corporate_action_id % 4 = 1 THEN record_received_date + 3 ELSE record_received_date END >= DATE '1997-01-01' AS is_current FROM actions""", NEWS, ACTIONS))  # fmt: skip
def action_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date that counts for an action (record, meeting, announcement) and whether it is still to come at a given day."""
    received, kind = F.col("record_received_date"), F.col("corporate_action_id") % 4
    record, meeting = F.when(kind == 0, F.date_add(received, 10)), F.when(kind == 1, F.date_add(received, 3))
    day = F.coalesce(record, meeting, received)
    return actions(spark, sf_dir).select("corporate_action_id", day.alias("life_date"), (day >= F.lit("1997-01-01").cast("date")).alias("is_current"))


@query(with_views("""SELECT n.news_id, n.security_id, m.exchange_tag, e.exchange FROM news n JOIN master m ON m.security_id = n.security_id JOIN (VALUES ('BOTH', 'NSE'), ('BOTH', 'BSE'), ('NSE', 'NSE'), ('BSE', 'BSE')) e(tag, exchange) ON e.tag = m.exchange_tag""", NEWS, MASTER))
def exchange_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each exchange on which an item's security trades."""
    rows = news(spark, sf_dir).select("news_id", "security_id").join(master(spark, sf_dir).select("security_id", "exchange_tag"), "security_id")
    return rows.select("news_id", "security_id", "exchange_tag", F.explode(M.exchanges(F.col("exchange_tag"))).alias("exchange"))


@query(with_views("""SELECT n.news_id, m.symbol, a.n_actions, p.event_type AS last_event FROM news n LEFT JOIN master m ON m.security_id = n.security_id
 LEFT JOIN (SELECT security_id, COUNT(*) AS n_actions FROM actions GROUP BY 1) a ON a.security_id = n.security_id
 LEFT JOIN (SELECT user_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1) p ON p.user_id = n.security_id""", NEWS, ACTIONS, MASTER))  # fmt: skip
def news_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with its security, a count of actions and the newest event; each side is one row a key before the join, so nothing fans out."""
    rows = news(spark, sf_dir).select("news_id", "security_id")
    counts = actions(spark, sf_dir).groupBy("security_id").agg(F.count("*").alias("n_actions"))
    last = latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    joined = rows.join(master(spark, sf_dir).select("security_id", "symbol"), "security_id", "left").join(counts, "security_id", "left")
    return joined.join(last.select(F.col("user_id").alias("security_id"), F.col("event_type").alias("last_event")), "security_id", "left").select("news_id", "symbol", "n_actions", "last_event")


@query(with_views("""SELECT security_id, trade_date, (SELECT FLOOR(AVG(v) * 1e4 + 0.5) / 1e4 FROM (SELECT UNNEST(LIST_SLICE(LIST_REVERSE(before), 1, 20)) AS v)) AS prior_volume FROM (
 SELECT security_id, trade_date, LIST(CASE WHEN volume % 7 > 0 THEN volume END) FILTER (WHERE volume % 7 > 0) OVER (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM bars) x""", BARS))
def prior_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last twenty known volumes strictly before each session; a volume divisible by 7 stands for an unknown one."""
    known = F.when(F.col("volume") % 7 > 0, F.col("volume"))
    order = Window.partitionBy("security_id").orderBy("trade_date")
    # running count and sum of known volumes; twenty of them back lie those with a count less by 20
    rows = bars(spark, sf_dir).select("security_id", "trade_date", known.alias("known"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"n": F.count("known").over(before), "total": F.coalesce(F.sum("known").over(before), F.lit(0.0))})
    counted = rows.filter("known IS NOT NULL").select("security_id", F.col("n").alias("back"), F.col("total").alias("earlier"))
    rows = rows.withColumn("back", F.greatest(F.col("n") - 20, F.lit(0)))
    joined = rows.join(counted, ["security_id", "back"], "left")
    return joined.select("security_id", "trade_date", quantized((F.col("total") - F.coalesce("earlier", F.lit(0.0))) / F.nullif(F.least(F.col("n"), F.lit(20)), F.lit(0))).alias("prior_volume"))


@query("""SELECT item_id, LEN(STRING_SPLIT(text, ' ')) AS n_words, SHA256(text) AS digest, UPPER(SUBSTRING(REGEXP_REPLACE(text, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120)) AS safe_name FROM benchmark""")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(F.split("text", " ")).alias("n_words"), F.sha2("text", 256).alias("digest"), F.upper(T.safe_file_name(F.col("text"))).alias("safe_name"))


@query("""SELECT DATE_TRUNC('week', ts) AS week, event_type, COUNT(*) AS arrivals, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def weekly_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed audit: rows and users of every week and kind."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").alias("week"), "event_type").agg(F.count("*").alias("arrivals"), F.countDistinct("user_id").alias("users"))


@query("""SELECT user_id, COUNT(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6' HOUR THEN 0 ELSE 1 END AS opens FROM events) x WHERE opens = 1 GROUP BY user_id""")
def arrival_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of arrivals that a gap of six hours ends."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(order)
    rows = table(spark, sf_dir, "events").select("user_id", F.when(gap < F.expr("INTERVAL '6' HOUR"), 0).otherwise(1).alias("opens"))
    return rows.filter("opens = 1").groupBy("user_id").agg(F.count("*").alias("sessions"))
