"""Reports on prices, corporate actions and the security master."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import market as M
from ..functions import text as T
from ..operators.asof import latest_per_key
from .facades import ACTIONS, BARS, MASTER, NEWS, actions, bars, master, quantized, table, with_views
from .registry import query

_MOVES = """moves AS (SELECT * FROM (SELECT security_id, trade_date, close, LAG(close) OVER w AS previous,
 ROW_NUMBER() OVER (PARTITION BY security_id ORDER BY trade_date DESC) AS newest FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)) x WHERE newest = 1)"""
_Q = "FLOOR(({}) * 1e4 + 0.5) / 1e4"


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest close of every security with the close before it.

    Only the two newest bars of a security matter, so an aggregate keeps the
    greatest date and then the greatest before it; no series is sorted.
    """
    rows = bars(spark, sf_dir).select("security_id", "trade_date", "close")
    newest = Window.partitionBy("security_id").orderBy(F.desc("trade_date"))
    top = rows.withColumn("n", F.row_number().over(newest)).filter("n <= 2")
    return top.groupBy("security_id").agg(F.max("trade_date").alias("trade_date"), F.max(F.when(F.col("n") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("n") == 2, F.col("close"))).alias("previous"))


@query(with_views("""SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE close > previous) AS advances, COUNT(*) FILTER (WHERE close < previous) AS declines,
 COUNT(*) FILTER (WHERE close = previous) AS unchanged, COUNT(*) FILTER (WHERE previous IS NULL) AS no_data,
 CASE WHEN COUNT(*) FILTER (WHERE close < previous) > 0 THEN FLOOR(COUNT(*) FILTER (WHERE close > previous) * 100.0 / COUNT(*) FILTER (WHERE close < previous) + 0.5) / 100.0 END AS ratio
 FROM moves WHERE trade_date = (SELECT MAX(trade_date) FROM moves)""", BARS, _MOVES))  # fmt: skip
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advances and declines on the latest date."""
    rows = movements(spark, sf_dir)
    last = rows.agg(F.max("trade_date").alias("trade_date"))
    up, down = F.count_if(F.col("close") > F.col("previous")), F.count_if(F.col("close") < F.col("previous"))
    counts = rows.join(F.broadcast(last), "trade_date", "left_semi").agg(F.count("*").alias("total"), up.alias("advances"), down.alias("declines"), F.count_if(F.col("close") == F.col("previous")).alias("unchanged"), F.count_if(F.col("previous").isNull()).alias("no_data"))
    return counts.withColumn("ratio", F.when(F.col("declines") > 0, F.floor(F.col("advances") * F.lit(100.0) / F.col("declines") + 0.5) / 100.0))


@query(with_views(f"""SELECT m.security_id, s.symbol, m.trade_date, m.close, m.previous, m.close - m.previous AS change,
 {_Q.format('(m.close - m.previous) / m.previous * 100')} AS change_percent FROM moves m JOIN master s ON s.security_id = m.security_id
 WHERE s.is_active""", BARS, MASTER, _MOVES))  # fmt: skip
def latest_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest movement of every active security, largest change first, those without one before all."""
    own = master(spark, sf_dir).filter("is_active").select("security_id", "symbol")
    change = F.col("close") - F.col("previous")
    rows = movements(spark, sf_dir).join(own, "security_id")
    rows = rows.select("security_id", "symbol", "trade_date", "close", "previous", change.alias("change"), quantized(M.ratio(change, F.col("previous")) * 100).alias("change_percent"))
    return rows.orderBy(F.desc_nulls_first("change_percent"), "security_id")


_TOP = """SELECT symbol, change_percent FROM (SELECT s.symbol, FLOOR((m.close - m.previous) / m.previous * 100 * 1e4 + 0.5) / 1e4 AS change_percent
 FROM moves m JOIN master s ON s.security_id = m.security_id WHERE m.trade_date = (SELECT MAX(trade_date) FROM moves)) x
 WHERE change_percent IS NOT NULL ORDER BY change_percent {}, symbol LIMIT 10"""


def _top(spark: SparkSession, sf_dir: str, descending: bool) -> DataFrame:
    rows = movements(spark, sf_dir)
    last = rows.agg(F.max("trade_date").alias("trade_date"))
    rows = rows.join(F.broadcast(last), "trade_date", "left_semi").join(master(spark, sf_dir).select("security_id", "symbol"), "security_id")
    rows = rows.select("symbol", quantized(M.ratio(F.col("close") - F.col("previous"), F.col("previous")) * 100).alias("change_percent")).filter("change_percent IS NOT NULL")
    return rows.orderBy(F.desc("change_percent") if descending else F.asc("change_percent"), "symbol").limit(10)


@query(with_views(_TOP.format("DESC"), BARS, MASTER, _MOVES))
def top_gainers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, True)


@query(with_views(_TOP.format("ASC"), BARS, MASTER, _MOVES))
def top_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, False)


@query(with_views("""SELECT COUNT(*) AS counted, FLOOR(COUNT(*) FILTER (WHERE close > previous) * 1e4 / COUNT(*) + 0.5) / 100 AS advance_percent,
 FLOOR(COUNT(*) FILTER (WHERE close < previous) * 1e4 / COUNT(*) + 0.5) / 100 AS decline_percent FROM moves WHERE previous IS NOT NULL""", BARS, _MOVES))  # fmt: skip
def breadth_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of advances and declines among the securities that have both closes."""
    share = lambda c: F.floor(F.count_if(c) * F.lit(1e4) / F.count("*") + 0.5) / 100
    return movements(spark, sf_dir).filter("previous IS NOT NULL").agg(F.count("*").alias("counted"), share(F.col("close") > F.col("previous")).alias("advance_percent"), share(F.col("close") < F.col("previous")).alias("decline_percent"))


def security_search(spark: SparkSession, sf_dir: str, text: str, limit: int = 20) -> DataFrame:
    """Securities whose symbol, name, exchange, tag or id holds the text; better matches first. Empty text finds nothing."""
    wanted = text.strip().upper()
    columns = [F.upper("symbol"), F.upper("instrument_name"), F.upper("exchange_name"), F.upper("exchange_tag"), F.col("security_id").cast("string")]
    hit = columns[0].contains(wanted)
    for c in columns[1:]:
        hit = hit | c.contains(wanted)
    symbol, name = F.upper("symbol"), F.upper("instrument_name")
    rank = F.when(symbol == wanted, 1).when(symbol.startswith(wanted), 2).when(name.startswith(wanted), 3).when(name.contains(wanted), 4).otherwise(5)
    rows = master(spark, sf_dir).filter(hit if wanted else F.lit(False)).select("security_id", "symbol", "instrument_name", rank.alias("relevance"), "is_active")
    return rows.orderBy("relevance", F.desc("is_active"), "symbol").limit(min(1000, max(1, limit)))


@query(with_views("""SELECT security_id, symbol, instrument_name, CASE WHEN symbol = 'SYM1' THEN 1 WHEN symbol LIKE 'SYM1%' THEN 2
 WHEN instrument_name LIKE 'SYM1%' THEN 3 WHEN instrument_name LIKE '%SYM1%' THEN 4 ELSE 5 END AS relevance, is_active FROM master
 WHERE symbol LIKE '%SYM1%' OR instrument_name LIKE '%SYM1%' OR UPPER(exchange_name) LIKE '%SYM1%' OR exchange_tag LIKE '%SYM1%' OR CAST(security_id AS VARCHAR) LIKE '%SYM1%'
 ORDER BY relevance, is_active DESC, symbol LIMIT 20""", MASTER))  # fmt: skip
def security_search_sym1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security_search(spark, sf_dir, "sym1")


@query(with_views("""SELECT exchange_tag, COUNT(*) AS securities, COALESCE(SUM(CASE WHEN is_active THEN 1 ELSE 0 END), 0)::BIGINT AS active,
 COUNT(DISTINCT exchange_name) AS regions FROM master WHERE exchange_tag IN ('NSE', 'BSE', 'BOTH') GROUP BY exchange_tag""", MASTER))  # fmt: skip
def security_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master(spark, sf_dir).filter(F.col("exchange_tag").isin("NSE", "BSE", "BOTH"))
    return rows.groupBy("exchange_tag").agg(F.count("*").alias("securities"), F.coalesce(F.sum(F.when(F.col("is_active"), 1).otherwise(0)), F.lit(0)).cast("long").alias("active"), F.countDistinct("exchange_name").alias("regions"))


_TYPE = """CASE WHEN subject LIKE '%Dividend%' THEN 'DIVIDEND' WHEN subject LIKE '%Bonus%' THEN 'BONUS' WHEN subject LIKE '%Rights%' THEN 'RIGHTS'
 WHEN subject LIKE '%Buy Back%' THEN 'BUYBACK' WHEN subject LIKE '%Board%' THEN 'BOARD_MEETING' ELSE 'OTHER' END"""


@query(with_views(f"""SELECT {_TYPE} AS action_type, COUNT(*) AS n, COUNT(DISTINCT security_id) AS securities, MAX(record_received_date) AS last_received
 FROM actions GROUP BY 1""", NEWS, ACTIONS))  # fmt: skip
def corporate_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = actions(spark, sf_dir).withColumn("action_type", M.action_type(F.col("subject")))
    return rows.groupBy("action_type").agg(F.count("*").alias("n"), F.countDistinct("security_id").alias("securities"), F.max("record_received_date").alias("last_received"))


@query(with_views(f"""SELECT corporate_action_id, a.security_id, s.symbol, record_received_date, subject, {_TYPE} IN ('BOARD_MEETING', 'OTHER') AS is_event
 FROM actions a LEFT JOIN master s ON s.security_id = a.security_id""", NEWS, ACTIONS, MASTER))  # fmt: skip
def corporate_actions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All actions with their symbol, newest first, undated last; board meetings and others are events."""
    rows = actions(spark, sf_dir).join(master(spark, sf_dir).select("security_id", "symbol"), "security_id", "left")
    rows = rows.select("corporate_action_id", "security_id", "symbol", "record_received_date", "subject", M.action_type(F.col("subject")).isin("BOARD_MEETING", "OTHER").alias("is_event"))
    return rows.orderBy(F.desc_nulls_last("record_received_date"), "symbol", "corporate_action_id")


@query(with_views("""SELECT d.corporate_action_id, d.security_id, d.amount, m.close AS latest_close, b.close AS received_close,
 CAST(FLOOR(d.amount / m.close * 100 * 1e4 + 0.5) / 1e4 AS DOUBLE) AS dividend_yield,
 CASE WHEN m.trade_date >= d.record_received_date THEN FLOOR((m.close / b.close - 1) * 100 * 1e4 + 0.5) / 1e4 END AS change_since_received
 FROM (SELECT corporate_action_id, security_id, record_received_date, CAST(NULLIF(REGEXP_EXTRACT(UPPER(subject), '(?:RS|RE)\\s*([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS amount FROM actions WHERE subject LIKE 'Dividend%') d
 JOIN moves m ON m.security_id = d.security_id
 LEFT JOIN (SELECT a.corporate_action_id, ARG_MAX(b.close, b.trade_date) AS close FROM actions a JOIN bars b ON b.security_id = a.security_id AND b.trade_date <= a.record_received_date WHERE a.subject LIKE 'Dividend%' GROUP BY 1) b
 ON b.corporate_action_id = d.corporate_action_id""", BARS, NEWS, ACTIONS, _MOVES))  # fmt: skip
def dividend_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dividends with yield on the latest close and the change since the record was received."""
    from ..operators.asof import as_of

    rows = actions(spark, sf_dir).filter(M.action_type(F.col("subject")) == "DIVIDEND").withColumn("amount", M.dividend_amount(F.col("subject")).cast("double"))
    rows = as_of(rows, bars(spark, sf_dir).select("security_id", "trade_date", "close"), "record_received_date", ["close"]).withColumnRenamed("close", "received_close").drop("base_date")
    latest = movements(spark, sf_dir).select("security_id", F.col("trade_date").alias("latest_date"), F.col("close").alias("latest_close"))
    rows = rows.join(latest, "security_id")
    since = F.when(F.col("latest_date") >= F.col("record_received_date"), quantized(M.change_rate(F.col("latest_close"), F.col("received_close")) * 100))
    return rows.select("corporate_action_id", "security_id", "amount", "latest_close", "received_close", quantized(M.ratio(F.col("amount"), F.col("latest_close")) * 100).alias("dividend_yield"), since.alias("change_since_received"))


@query(with_views("""SELECT security_id, trade_date, close FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY security_id ORDER BY trade_date DESC) AS n FROM bars) x WHERE n <= 5""", BARS))
def last_five_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("security_id").orderBy(F.desc("trade_date"))
    return bars(spark, sf_dir).withColumn("n", F.row_number().over(newest)).filter("n <= 5").select("security_id", "trade_date", "close")


@query(with_views("""SELECT security_id, trade_date, FLOOR(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END * 1e4 + 0.5) / 1e4 AS scaled
 FROM (SELECT *, MIN(close) OVER (PARTITION BY security_id) AS lo, MAX(close) OVER (PARTITION BY security_id) AS hi FROM bars) x""", BARS))  # fmt: skip
def trend_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every close between its security's least and greatest."""
    all_ = Window.partitionBy("security_id")
    low, high = F.min("close").over(all_), F.max("close").over(all_)
    rows = bars(spark, sf_dir).select("security_id", "trade_date", "close", low.alias("lo"), high.alias("hi"))
    return rows.select("security_id", "trade_date", quantized(F.when(F.col("hi") > F.col("lo"), (F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias("scaled"))


@query("""SELECT s_suppkey AS security_id, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(UPPER(s_name), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS name_key,
 REGEXP_REPLACE(UPPER(s_name), '[^A-Z0-9]', '', 'g') AS symbol_key FROM supplier""")  # fmt: skip
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"), T.normalized_name(F.col("s_name")).alias("name_key"), T.normalized_symbol(F.col("s_name")).alias("symbol_key"))


@query("""SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN url IS NULL OR TRIM(url) = '' THEN 'NONE' WHEN path LIKE '%.pdf' THEN 'PDF' WHEN path LIKE '%.xml' THEN 'XML'
 WHEN path LIKE '%.html' OR path LIKE '%.htm' THEN 'HTML' ELSE 'OTHER' END AS kind FROM (SELECT url, LOWER(REGEXP_REPLACE(REGEXP_REPLACE(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]*', '')) AS path FROM pages) x) y GROUP BY kind""")  # fmt: skip
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(T.url_class(F.col("url")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) x WHERE n = 1""")
def latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of every key."""
    return latest_per_key(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")])
