"""Time-series queries: as-of prices, labels, indicators, event features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import market as M
from ..operators import asof, series
from .facades import BARS, NEWS, bars, news, quantized, table, with_views
from .registry import query

_CUT = """cut AS (SELECT *, CAST(published_at AS DATE) - CASE WHEN CAST(published_at AS TIME) > TIME '15:30:00' THEN 0 ELSE 1 END AS cutoff FROM news)"""
_NUM = "num AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY security_id ORDER BY trade_date) AS session FROM bars)"
_BASE = """base AS (SELECT c.news_id, c.security_id, c.published_at, c.cutoff, n.session, n.trade_date AS base_date, n.close FROM cut c JOIN (
 SELECT c.news_id, MAX(n.session) AS session FROM cut c JOIN num n ON n.security_id = c.security_id AND n.trade_date <= c.cutoff GROUP BY 1) m ON m.news_id = c.news_id
 JOIN num n ON n.security_id = c.security_id AND n.session = m.session)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.numbered(bars(spark, sf_dir))


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with cutoff, base session, base date and base close; news before the first session is left out."""
    events = news(spark, sf_dir).select("news_id", "security_id", "published_at", M.prediction_cutoff(F.col("published_at")).alias("cutoff"))
    return asof.as_of(events, _sessions(spark, sf_dir).select("security_id", "trade_date", "session", "close"), "cutoff", ["session", "close"]).filter("session IS NOT NULL")


@query(with_views("SELECT news_id, security_id, cutoff, base_date, close AS base_close FROM base", BARS, NEWS, _CUT, _NUM, _BASE))
def as_of_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return based(spark, sf_dir).select("news_id", "security_id", "cutoff", "base_date", F.col("close").alias("base_close"))


@query(with_views("""SELECT news_id, FLOOR((c1 / close - 1) * 1e6 + 0.5) / 1e6 AS return_1d, FLOOR((c3 / close - 1) * 1e6 + 0.5) / 1e6 AS return_3d,
 FLOOR((c5 / close - 1) * 1e6 + 0.5) / 1e6 AS return_5d, FLOOR((c10 / close - 1) * 1e6 + 0.5) / 1e6 AS return_10d,
 CASE WHEN c1 IS NULL THEN NULL WHEN c1 / close - 1 >= 0.0075 THEN 'POSITIVE' WHEN c1 / close - 1 <= -0.0075 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction_1d
 FROM (SELECT b.news_id, b.close, n1.close AS c1, n3.close AS c3, n5.close AS c5, n10.close AS c10 FROM base b
 LEFT JOIN num n1 ON n1.security_id = b.security_id AND n1.session = b.session + 1 LEFT JOIN num n3 ON n3.security_id = b.security_id AND n3.session = b.session + 3
 LEFT JOIN num n5 ON n5.security_id = b.security_id AND n5.session = b.session + 5 LEFT JOIN num n10 ON n10.security_id = b.security_id AND n10.session = b.session + 10) x""", BARS, NEWS, _CUT, _NUM, _BASE))  # fmt: skip
def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over the next 1, 3, 5 and 10 sessions and the direction of the first.

    The closes ahead are attached to each session by one window before the
    as-of step, so events need no further join.
    """
    order = Window.partitionBy("security_id").orderBy("trade_date")
    ahead = bars(spark, sf_dir).select("security_id", "trade_date", "close", *[F.lead("close", k).over(order).alias(f"c{k}") for k in (1, 3, 5, 10)])
    events = news(spark, sf_dir).select("news_id", "security_id", M.prediction_cutoff(F.col("published_at")).alias("cutoff"))
    rows = asof.as_of(events, ahead, "cutoff", ["close", "c1", "c3", "c5", "c10"]).filter("base_date IS NOT NULL")
    rate = {k: M.change_rate(F.col(f"c{k}"), F.col("close")) for k in (1, 3, 5, 10)}
    return rows.select("news_id", *[quantized(rate[k], 1e6).alias(f"return_{k}d") for k in (1, 3, 5, 10)], M.direction(rate[1]).alias("direction_1d"))


@query(with_views("""SELECT c.news_id, COUNT(b.trade_date) AS n_rows FROM cut c LEFT JOIN bars b ON b.security_id = c.security_id
 AND b.trade_date BETWEEN c.cutoff - 140 AND c.cutoff GROUP BY c.news_id""", BARS, NEWS, _CUT))  # fmt: skip
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in the 140 days up to each cutoff."""
    events = news(spark, sf_dir).select("news_id", "security_id", M.prediction_cutoff(F.col("published_at")).alias("cutoff"))
    return asof.counted_between(events, bars(spark, sf_dir), "cutoff", 140).select("news_id", "n_rows")


@query(with_views("""SELECT security_id, trade_date, FLOOR(sma_20 * 1e4 + 0.5) / 1e4 AS sma_20, FLOOR(std_20 * 1e4 + 0.5) / 1e4 AS std_20,
 FLOOR((close / c10 - 1) * 1e4 + 0.5) / 1e4 AS momentum_10, FLOOR((close - (sma_20 - 2 * std_20)) / NULLIF(4 * std_20, 0) * 1e4 + 0.5) / 1e4 AS bb_position,
 FLOOR((high - low) / close * 1e4 + 0.5) / 1e4 AS range_percent, FLOOR(volume / NULLIF(v5, 0) * 1e4 + 0.5) / 1e4 AS volume_ratio_5,
 FLOOR(atr * 1e4 + 0.5) / 1e4 AS atr_14, FLOOR(vol5 * 1e4 + 0.5) / 1e4 AS volatility_5d FROM (
 SELECT *, CASE WHEN COUNT(close) OVER w20 = 20 THEN AVG(close) OVER w20 END AS sma_20, CASE WHEN COUNT(close) OVER w20 = 20 THEN STDDEV_SAMP(close) OVER w20 END AS std_20,
 LAG(close, 10) OVER o AS c10, CASE WHEN COUNT(volume) OVER p5 = 5 THEN AVG(volume) OVER p5 END AS v5,
 CASE WHEN COUNT(tr) OVER w14 = 14 THEN AVG(tr) OVER w14 END AS atr, CASE WHEN COUNT(r) OVER w5 = 5 THEN STDDEV_SAMP(r) OVER w5 END AS vol5 FROM (
 SELECT *, close / NULLIF(LAG(close) OVER o, 0) - 1 AS r, CASE WHEN LAG(close) OVER o IS NOT NULL THEN GREATEST(high - low, ABS(high - LAG(close) OVER o), ABS(low - LAG(close) OVER o)) END AS tr
 FROM bars WINDOW o AS (PARTITION BY security_id ORDER BY trade_date)) q
 WINDOW o AS (PARTITION BY security_id ORDER BY trade_date), w20 AS (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
 w14 AS (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
 p5 AS (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) x""", BARS))  # fmt: skip
def rolling_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.rolling(bars(spark, sf_dir))
    return rows.select("security_id", "trade_date", *[quantized(F.col(c)).alias(c) for c in ("sma_20", "std_20", "momentum_10", "bb_position", "range_percent", "volume_ratio_5", "atr_14", "volatility_5d")])


_SLICE = """slice AS (SELECT b.news_id, n.close, n.session - b.session + 60 AS i FROM base b JOIN num n ON n.security_id = b.security_id AND n.session BETWEEN b.session - 59 AND b.session WHERE b.session >= 60)"""


@query(with_views("""SELECT news_id, FLOOR(SUM(CASE WHEN i = 1 THEN POWER(11 / 13e0, 59) ELSE 2 / 13e0 * POWER(11 / 13e0, 60 - i) END * close) * 1e4 + 0.5) / 1e4 AS ema_12,
 FLOOR(SUM(CASE WHEN i = 1 THEN POWER(25 / 27e0, 59) ELSE 2 / 27e0 * POWER(25 / 27e0, 60 - i) END * close) * 1e4 + 0.5) / 1e4 AS ema_26,
 FLOOR((100 - 100 / (1 + SUM(CASE WHEN i <= 15 THEN POWER(13 / 14e0, 45) / 14 ELSE POWER(13 / 14e0, 60 - i) / 14 END * GREATEST(d, 0)) /
 SUM(CASE WHEN i <= 15 THEN POWER(13 / 14e0, 45) / 14 ELSE POWER(13 / 14e0, 60 - i) / 14 END * GREATEST(-d, 0)))) * 1e4 + 0.5) / 1e4 AS rsi_14
 FROM (SELECT *, close - LAG(close) OVER (PARTITION BY news_id ORDER BY i) AS d FROM slice) x GROUP BY news_id""", BARS, NEWS, _CUT, _NUM, _BASE, _SLICE))  # fmt: skip
def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA and RSI folded over the 60 closes up to each news item's base session."""
    rows = series.slices(based(spark, sf_dir).select("news_id", "security_id", "session"), bars(spark, sf_dir))
    closes = F.col("closes")
    return rows.select("news_id", quantized(series.ema(closes, 12)).alias("ema_12"), quantized(series.ema(closes, 26)).alias("ema_26"), quantized(series.rsi(closes)).alias("rsi_14"))


@query(with_views("""SELECT news_id, FLOOR(AVG(close) FILTER (WHERE i > 55) * 1e4 + 0.5) / 1e4 AS mean_5, FLOOR(AVG(close) FILTER (WHERE i > 40) * 1e4 + 0.5) / 1e4 AS mean_20,
 FLOOR((MAX(close) FILTER (WHERE i = 60) / MAX(close) FILTER (WHERE i = 55) - 1) * 1e4 + 0.5) / 1e4 AS return_5d_back,
 FLOOR((MAX(close) FILTER (WHERE i = 60) / MAX(close) FILTER (WHERE i > 40) - 1) * 1e4 + 0.5) / 1e4 AS from_high_20,
 FLOOR((MAX(close) FILTER (WHERE i = 60) / MIN(close) FILTER (WHERE i > 40) - 1) * 1e4 + 0.5) / 1e4 AS from_low_20,
 FLOOR(REGR_SLOPE(close, i) FILTER (WHERE i > 40) * 1e4 + 0.5) / 1e4 AS slope_20, MIN(FLOOR((close / top - 1) * 1e4 + 0.5) / 1e4) AS drawdown_60,
 MIN(hour) AS hour, MIN(weekday) AS weekday, BOOL_OR(post) AS post_market FROM (SELECT s.*, MAX(s.close) OVER (PARTITION BY s.news_id ORDER BY s.i) AS top,
 EXTRACT(HOUR FROM b.published_at)::INT AS hour, EXTRACT(DOW FROM b.published_at)::INT AS weekday, CAST(b.published_at AS TIME) > TIME '15:30:00' AS post
 FROM slice s JOIN base b ON b.news_id = s.news_id) x GROUP BY news_id""", BARS, NEWS, _CUT, _NUM, _BASE, _SLICE))  # fmt: skip
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature row of every news item with 60 sessions: slices built once for each session, features as folds over them."""
    rows = series.slices(based(spark, sf_dir).select("news_id", "security_id", "session", "published_at"), bars(spark, sf_dir))
    c = F.col("closes")
    last20 = F.slice(c, -20, 20)
    last = F.element_at(c, -1)
    places = F.sequence(F.lit(1), F.lit(20))
    mean = F.aggregate(last20, F.lit(0.0), lambda a, x: a + x) / 20
    slope = F.aggregate(F.zip_with(last20, places, lambda y, i: (i - 10.5) * (y - mean)), F.lit(0.0), lambda a, x: a + x) / 665.0
    at = F.col("published_at")
    return rows.select(
        "news_id",
        quantized(series.mean_of_last(c, 5)).alias("mean_5"),
        quantized(series.mean_of_last(c, 20)).alias("mean_20"),
        quantized(M.change_rate(last, F.element_at(c, -6))).alias("return_5d_back"),
        quantized(M.change_rate(last, F.array_max(last20))).alias("from_high_20"),
        quantized(M.change_rate(last, F.array_min(last20))).alias("from_low_20"),
        quantized(slope).alias("slope_20"),
        quantized(series.drawdown(c)).alias("drawdown_60"),
        F.hour(at).alias("hour"),
        (F.dayofweek(at) - 1).alias("weekday"),
        M.session_phase(at)[1].alias("post_market"),
    )


@query(with_views("SELECT news_id, i::BIGINT AS sequence_index, close FROM slice", BARS, NEWS, _CUT, _NUM, _BASE, _SLICE))
def point_in_time_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 sessions up to each item's base session, one row each."""
    rows = series.slices(based(spark, sf_dir).select("news_id", "security_id", "session"), bars(spark, sf_dir))
    return rows.select("news_id", F.posexplode("closes").alias("at", "close")).select("news_id", (F.col("at") + 1).cast("long").alias("sequence_index"), "close")


@query(with_views("""SELECT news_id, base_date, FLOOR((c1 / close - 1) * 100 * 1e4 + 0.5) / 1e4 AS return_1d, FLOOR((c5 / close - 1) * 100 * 1e4 + 0.5) / 1e4 AS return_5d, FLOOR(v1 / v20 * 1e4 + 0.5) / 1e4 AS volume_ratio,
 CASE WHEN base_date IS NULL THEN 'NO_BASE_PRICE' WHEN c5 IS NULL THEN 'INSUFFICIENT_FUTURE_DATA' ELSE 'CALCULATED' END AS status FROM (
 SELECT w.news_id, n.trade_date AS base_date, n.close, n.c1, n.c5, n.v1, n.v20 FROM news w LEFT JOIN (SELECT w.news_id, MAX(n.session) AS session FROM news w JOIN num n ON n.security_id = w.security_id
 AND n.trade_date <= CAST(w.published_at AS DATE) GROUP BY 1) m ON m.news_id = w.news_id LEFT JOIN (SELECT *, LEAD(close) OVER o AS c1, LEAD(close, 5) OVER o AS c5, LEAD(volume) OVER o AS v1,
 AVG(volume) OVER (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v20 FROM num WINDOW o AS (PARTITION BY security_id ORDER BY trade_date)) n
 ON n.security_id = w.security_id AND n.session = m.session) x""", BARS, NEWS, _NUM))  # fmt: skip
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent returns and volume reaction after the close of the event date."""
    order = Window.partitionBy("security_id").orderBy("trade_date")
    ahead = bars(spark, sf_dir).select("security_id", "trade_date", "close", F.lead("close").over(order).alias("c1"), F.lead("close", 5).over(order).alias("c5"), F.lead("volume").over(order).alias("v1"), F.avg("volume").over(order.rowsBetween(-20, -1)).alias("v20"))
    events = news(spark, sf_dir).select("news_id", "security_id", F.col("published_at").cast("date").alias("event_date"))
    rows = asof.as_of(events, ahead, "event_date", ["close", "c1", "c5", "v1", "v20"])
    status = F.when(F.col("base_date").isNull(), "NO_BASE_PRICE").when(F.col("c5").isNull(), "INSUFFICIENT_FUTURE_DATA").otherwise("CALCULATED")
    percent = lambda c: quantized(M.change_rate(F.col(c), F.col("close")) * 100)
    return rows.select("news_id", "base_date", percent("c1").alias("return_1d"), percent("c5").alias("return_5d"), quantized(M.ratio(F.col("v1"), F.col("v20"))).alias("volume_ratio"), status.alias("status"))


@query(with_views("""SELECT security_id, MIN(day) AS window_start, MAX(day) AS window_end FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY security_id, run ORDER BY day) - 1) // 7 AS w FROM (
 SELECT security_id, day, day - CAST(ROW_NUMBER() OVER (PARTITION BY security_id ORDER BY day) AS INTEGER) AS run FROM (SELECT s_suppkey AS security_id, CAST(UNNEST(GENERATE_SERIES(TIMESTAMP '1993-01-01', TIMESTAMP '1997-12-31', INTERVAL '1' DAY)) AS DATE) AS day FROM supplier) d
 WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.security_id = d.security_id AND b.trade_date = d.day)) o) x GROUP BY security_id, run, w""", BARS))  # fmt: skip
def backfill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of up to seven days in which a security has no session, for the backfill to ask for."""
    known = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").alias("day"))
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"))
    return series.missing_windows(known, keys, "security_id", "day", "1993-01-01", "1997-12-31")
