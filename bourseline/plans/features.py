"""The event-feature row: one for each news item, security and exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as M
from ..operators import sessions
from .facades import BARS, MASTER, NEWS, bars, master, news, with_views
from .registry import query
from .series import _CUT

_SPANS = (5, 10, 20)
#: Columns of the row that are rounded numbers.
NUMBERS = (
    "close", "open", "high", "low", "volume", "turnover", "daily_return", "sma_5", "sma_10", "sma_20", "volatility_5d", "relative_volume_20", "close_vs_sma20", "volume_ratio_5", "range_percent",
    *(f"momentum_{n}" for n in _SPANS), *(f"return_mean_{n}d" for n in _SPANS), *(f"return_std_{n}d" for n in _SPANS), *(f"volatility_mean_{n}d" for n in _SPANS), *(f"volume_ratio_mean_{n}d" for n in _SPANS),
    "volume_mean_5d", "volume_mean_20d", "high_20d", "low_20d", "distance_from_high_20d", "distance_from_low_20d", "max_drawdown_20d", "price_trend_20d", "volume_trend_20d",
    *(f"backward_return_{n}d" for n in (1, 5, 10)), *(f"forward_return_{n}d" for n in (1, 3, 5, 10)),
)


def _sql() -> str:
    frame = lambda n, last=0: f"(PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN {n - 1 - last} PRECEDING AND {f'{-last} PRECEDING' if last else 'CURRENT ROW'})"
    full = lambda f, c, n, last=0: f"CASE WHEN COUNT({c}) OVER {frame(n, last)} = {n} THEN {f}({c}) OVER {frame(n, last)} END"
    near = lambda f, c, n: f"{f}({c}) OVER {frame(n)}"
    o = "OVER (PARTITION BY security_id ORDER BY trade_date)"
    rate = lambda a, b: f"{a} / NULLIF({b}, 0) - 1"
    one = f"SELECT *, ROW_NUMBER() {o} AS session, {rate('close', f'LAG(close) {o}')} AS daily_return FROM bars"
    two = f"""SELECT *, {', '.join(f"{full('AVG', 'close', n)} AS sma_{n}" for n in _SPANS)}, {full('STDDEV_SAMP', 'daily_return', 5)} AS volatility_5d, volume / NULLIF({full('AVG', 'volume', 20)}, 0) AS relative_volume_20,
 volume / NULLIF({full('AVG', 'volume', 5, -1)}, 0) AS volume_ratio_5, (high - low) / NULLIF(close, 0) AS range_percent, {', '.join(f"{rate('close', f'LAG(close, {n}) {o}')} AS momentum_{n}" for n in _SPANS)} FROM ({one}) s1"""
    means = [f"{near('AVG', c, n)} AS {name}_{n}d" for c, name in (("daily_return", "return_mean"), ("volatility_5d", "volatility_mean"), ("volume_ratio_5", "volume_ratio_mean")) for n in _SPANS]
    three = f"""SELECT *, {rate('close', 'sma_20')} AS close_vs_sma20, {', '.join(means)}, {', '.join(f"{near('STDDEV_SAMP', 'daily_return', n)} AS return_std_{n}d" for n in _SPANS)}, {near('AVG', 'volume', 5)} AS volume_mean_5d, {near('AVG', 'volume', 20)} AS volume_mean_20d,
 {near('MAX', 'close', 20)} AS high_20d, {near('MIN', 'close', 20)} AS low_20d, {', '.join(f"CASE WHEN COUNT({c}) OVER {frame(20)} >= 2 THEN REGR_SLOPE({c}, session) OVER {frame(20)} END AS {name}_trend_20d" for c, name in (("close", "price"), ("volume", "volume")))},
 LIST(close) OVER {frame(20)} AS closes, {', '.join(f"{rate('close', f'LAG(close, {n}) {o}')} AS backward_return_{n}d" for n in (1, 5, 10))}, {', '.join(f"{rate(f'LEAD(close, {n}) {o}', 'close')} AS forward_return_{n}d" for n in (1, 3, 5, 10))} FROM ({two}) s2"""
    feats = f"""feats AS (SELECT *, {rate('close', 'high_20d')} AS distance_from_high_20d, {rate('close', 'low_20d')} AS distance_from_low_20d,
 LIST_MIN(LIST_TRANSFORM(RANGE(1, LEN(closes) + 1), lambda i: closes[i] / LIST_MAX(closes[1:i]) - 1)) AS max_drawdown_20d FROM ({three}) s3)"""
    last = "lastday AS (SELECT c.news_id, MAX(b.trade_date) AS base_date FROM cut c JOIN bars b ON b.security_id = c.security_id AND b.trade_date <= c.cutoff GROUP BY 1)"
    numbers = ", ".join(f"FLOOR({c} * 1e4 + 0.5) / 1e4 AS {c}" for c in NUMBERS)
    way = ", ".join(f"CASE WHEN forward_return_{n}d IS NULL THEN NULL WHEN forward_return_{n}d >= 0.0075 THEN 'POSITIVE' WHEN forward_return_{n}d <= -0.0075 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction_{n}d, forward_return_{n}d IS NOT NULL AS has_{n}d_label" for n in (1, 3, 5, 10))
    body = f"""SELECT c.news_id, c.security_id, x.exchange, c.category AS feed_category, EXTRACT(HOUR FROM published_at)::INT AS publication_hour, EXTRACT(MINUTE FROM published_at)::INT AS publication_minute, EXTRACT(DOW FROM published_at)::INT AS publication_weekday,
 CAST(published_at AS TIME) < TIME '09:15:00' AS is_pre_market, CAST(published_at AS TIME) > TIME '15:30:00' AS is_post_market, c.cutoff AS cutoff_trade_date, l.base_date AS event_trade_date, {numbers}, {way},
 LEAST(COALESCE(session, 0), 60)::INT AS sequence_rows, COALESCE(session, 0) >= 20 AS prediction_eligible, CASE WHEN session IS NULL THEN 'NO_HISTORY' WHEN session < 20 THEN 'INSUFFICIENT_HISTORY' END AS prediction_note
 FROM cut c JOIN (SELECT security_id, UNNEST(CASE exchange_tag WHEN 'BOTH' THEN ['NSE', 'BSE'] WHEN 'BSE' THEN ['BSE'] ELSE ['NSE'] END) AS exchange FROM master) x ON x.security_id = c.security_id
 LEFT JOIN lastday l ON l.news_id = c.news_id LEFT JOIN feats f ON f.security_id = c.security_id AND f.trade_date = l.base_date"""
    return with_views(body, BARS, NEWS, MASTER, _CUT, feats, last)


@query(_sql())
def event_feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, price, volume and label features of every item, security and exchange as known at the item's cutoff.

    Bars and items meet in one sorted run for each security; no session's row moves through a shuffle.
    """
    prices, ahead = bars(spark, sf_dir), (1, 3, 5, 10)
    at = F.col("published_at")
    items = news(spark, sf_dir).select("news_id", "security_id", F.col("category").alias("feed_category"), "published_at", M.prediction_cutoff(at).alias("cutoff_trade_date"))
    tags = master(spark, sf_dir).select("security_id", M.exchanges(F.col("exchange_tag")).alias("each"))
    rows = sessions.at_events(items, prices, "cutoff_trade_date", list(NUMBERS), 1e4, [f"forward_return_{n}d" for n in ahead]).join(tags, "security_id").withColumn("exchange", F.explode("each"))
    before, after = M.session_phase(at)
    return rows.select(
        "news_id", "security_id", "exchange", "feed_category", F.hour(at).alias("publication_hour"), F.minute(at).alias("publication_minute"), (F.dayofweek(at) - 1).alias("publication_weekday"),
        before.alias("is_pre_market"), after.alias("is_post_market"), "cutoff_trade_date", "event_trade_date", *NUMBERS,
        *[M.direction(F.col(f"forward_return_{n}d_exact")).alias(f"direction_{n}d") for n in ahead], *[F.col(f"forward_return_{n}d").isNotNull().alias(f"has_{n}d_label") for n in ahead],
        F.least(F.coalesce("session", F.lit(0)), F.lit(60)).alias("sequence_rows"), (F.coalesce("session", F.lit(0)) >= 20).alias("prediction_eligible"),
        F.when(F.col("session").isNull(), "NO_HISTORY").when(F.col("session") < 20, "INSUFFICIENT_HISTORY").alias("prediction_note"),
    )
