"""Files matched to the security master, and the master, actions and mappings after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping, matching, upsert
from .facades import NEWS, news, table, with_views
from .registry import query

_LISTED = """listed AS (SELECT p_partkey AS security_id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 3 THEN 'INF' || LPAD(CAST(p_partkey AS VARCHAR), 9, '0') ELSE 'INE' || LPAD(CAST(p_partkey - CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END AS VARCHAR), 9, '0') END AS isin,
 'SYM' || CAST(p_partkey // 2 AS VARCHAR) AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'EQ' WHEN 1 THEN 'BE' ELSE 'SM' END AS series, p_name AS name,
 CASE WHEN p_partkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, CASE p_partkey % 5 WHEN 0 THEN 'BOTH' WHEN 1 THEN 'BSE' WHEN 2 THEN NULL ELSE 'NSE' END AS exchange_tag FROM part)"""
_RECORDS = """records AS (SELECT l_orderkey * 10 + l_linenumber AS record_id, CASE l_orderkey % 4 WHEN 0 THEN 'DUMMY' WHEN 1 THEN '' WHEN 2 THEN ' inf' || LPAD(CAST(l_partkey AS VARCHAR), 9, '0') ELSE ' ine' || LPAD(CAST(l_partkey AS VARCHAR), 9, '0') END AS isin,
 CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE 'sym' || CAST(l_partkey // 2 AS VARCHAR) END AS symbol, CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'eq' ELSE 'BE' END AS series, l_shipdate AS seen FROM lineitem)"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master in which identifiers are missing, shared and of different exchanges."""
    key = F.col("p_partkey")
    isin = F.when(key % 7 == 0, None).when(key % 11 == 3, F.concat(F.lit("INF"), F.lpad(key.cast("string"), 9, "0")))
    isin = isin.otherwise(F.concat(F.lit("INE"), F.lpad((key - F.when(key % 10 == 1, 1).otherwise(0)).cast("string"), 9, "0")))
    series = F.when(key % 3 == 0, "EQ").when(key % 3 == 1, "BE").otherwise("SM")
    tag = F.when(key % 5 == 0, "BOTH").when(key % 5 == 1, "BSE").when(key % 5 != 2, "NSE")
    return table(spark, sf_dir, "part").select(key.alias("security_id"), isin.alias("isin"), F.concat(F.lit("SYM"), F.floor(key / 2).cast("string")).alias("symbol"), series.alias("series"), F.col("p_name").alias("name"), F.when(key % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), tag.alias("exchange_tag"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files with dummy, blank and lower-case identifiers."""
    order = F.col("l_orderkey")
    isin = F.when(order % 4 == 0, "DUMMY").when(order % 4 == 1, "").otherwise(F.concat(F.when(order % 4 == 2, " inf").otherwise(" ine"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")))
    symbol = F.when(order % 9 != 0, F.concat(F.lit("sym"), F.floor(F.col("l_partkey") / 2).cast("string")))
    series = F.when(order % 3 == 0, "").when(order % 3 == 1, "eq").otherwise("BE")
    return table(spark, sf_dir, "lineitem").select((order * 10 + F.col("l_linenumber")).alias("record_id"), isin.alias("isin"), symbol.alias("symbol"), series.alias("series"), F.col("l_shipdate").alias("seen"))


_FIRST = "(SELECT UPPER(TRIM(isin)) AS k, MIN(security_id) AS id, MAX(security_id) AS last FROM listed WHERE isin IS NOT NULL GROUP BY 1)"
_SYMBOL = "(SELECT UPPER(TRIM(symbol)) AS k, MIN(security_id) AS id, MAX(security_id) AS last FROM listed GROUP BY 1)"


@query(with_views(f"""SELECT record_id, COALESCE(i.id, s.id) AS security_id, CASE WHEN i.id IS NOT NULL THEN 'ISIN' WHEN s.id IS NOT NULL THEN 'SYMBOL' ELSE 'UNMATCHED' END AS match_method
 FROM records r LEFT JOIN {_FIRST} i ON i.k = UPPER(TRIM(r.isin)) LEFT JOIN {_SYMBOL} s ON s.k = UPPER(TRIM(r.symbol))""", _LISTED, _RECORDS))  # fmt: skip
def isin_then_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.by_isin_then_symbol(records(spark, sf_dir), listed(spark, sf_dir)).select("record_id", "security_id", "match_method")


@query(with_views(f"""SELECT record_id, COALESCE(i.id, s.id) AS security_id, CASE WHEN i.id IS NOT NULL THEN 'ISIN' WHEN s.id IS NOT NULL THEN 'SYMBOL' END AS match_method FROM records r
 LEFT JOIN {_FIRST} i ON i.k = UPPER(TRIM(r.isin)) AND REGEXP_MATCHES(UPPER(TRIM(r.isin)), '^INE[A-Z0-9]{{9}}$')
 LEFT JOIN (SELECT symbol AS k, series AS x, MIN(security_id) AS id FROM listed GROUP BY 1, 2 UNION ALL SELECT symbol, '', MIN(security_id) FROM listed GROUP BY 1) s ON s.k = UPPER(r.symbol) AND s.x = UPPER(r.series)""", _LISTED, _RECORDS))  # fmt: skip
def actions_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions: real ISIN, else symbol within the named series, the least id first."""
    return matching.actions_to_master(records(spark, sf_dir), listed(spark, sf_dir)).select("record_id", "security_id", "match_method")


@query(with_views(f"""SELECT record_id, COALESCE(i.last, s.last) AS security_id, CASE WHEN i.last IS NOT NULL THEN 1.0 WHEN s.last IS NOT NULL THEN 0.95 END AS confidence, CASE WHEN COALESCE(i.last, s.last) IS NULL THEN 'PENDING' ELSE 'MAPPED' END AS status
 FROM records r LEFT JOIN {_FIRST.replace("WHERE", "WHERE exchange = 'NSE' AND")} i ON i.k = UPPER(TRIM(r.isin)) LEFT JOIN {_SYMBOL.replace("GROUP", "WHERE exchange = 'NSE' GROUP")} s ON s.k = UPPER(TRIM(r.symbol))""", _LISTED, _RECORDS))  # fmt: skip
def news_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.news_to_master(records(spark, sf_dir), listed(spark, sf_dir)).select("record_id", "security_id", "confidence", "status")


@query(with_views("""SELECT record_id, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 AND tag IN ('BOTH', 'BSE') THEN tag WHEN n = 1 AND x = 'BSE' THEN 'BSE' ELSE 'UNMATCHED' END AS resolution,
 CASE WHEN n = 1 AND (tag IN ('BOTH', 'BSE') OR x = 'BSE') THEN id END AS security_id FROM records r
 LEFT JOIN (SELECT isin AS k, COUNT(*) AS n, MIN(security_id) AS id, MIN(exchange_tag) AS tag, MIN(exchange) AS x FROM listed WHERE isin IS NOT NULL GROUP BY 1) m ON m.k = UPPER(TRIM(r.isin))""", _LISTED, _RECORDS))  # fmt: skip
def prices_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of one exchange: the security's tag, AMBIGUOUS or UNMATCHED."""
    return matching.prices_to_master(records(spark, sf_dir), listed(spark, sf_dir)).select("record_id", "resolution", "security_id")


@query(with_views("""SELECT l.security_id, c.c_custkey AS customer FROM listed l LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = REPLACE(CAST(l.security_id AS VARCHAR) || CASE WHEN l.security_id % 2 = 0 THEN '.0' ELSE '' END, '.0', '')""", _LISTED))
def instrument_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that are not ISINs joined to instrument numbers; some were written as decimals."""
    text = F.concat(F.col("security_id").cast("string"), F.when(F.col("security_id") % 2 == 0, ".0").otherwise(""))
    rows = listed(spark, sf_dir).select("security_id", matching.instrument_id(text).alias("number"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("customer"))
    return matching.lookup(rows, ids, {"number": "id"}).select("security_id", "customer")


@query(with_views("""SELECT symbol, ARG_MIN(COALESCE(isin, '?'), security_id) AS isin FROM listed GROUP BY 1""", _LISTED))
def isin_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ISIN of each symbol's first row, also where that one has none."""
    return matching.first_isin_of_symbol(listed(spark, sf_dir), "security_id").select("symbol", F.coalesce("isin", F.lit("?")).alias("isin"))


_SEEN = """seen AS (SELECT 'INE' || LPAD(CAST(c_custkey * 3 AS VARCHAR), 9, '0') AS isin, 'NEW' || CAST(c_custkey AS VARCHAR) AS symbol, 'EQ' AS series, c_name AS name FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 13 <> 0
 UNION ALL SELECT NULL, 'SYM' || CAST(c_custkey AS VARCHAR), 'EQ', c_name FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 13 <> 0
 UNION ALL SELECT NULL, NULL, NULL, c_name FROM customer WHERE c_custkey % 13 = 0)"""


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    bare, named = key % 4 == 0, key % 13 != 0
    return table(spark, sf_dir, "customer").select(F.when(~bare & named, F.concat(F.lit("INE"), F.lpad((key * 3).cast("string"), 9, "0"))).alias("isin"), F.when(named, F.concat(F.when(bare, "SYM").otherwise("NEW"), key.cast("string"))).alias("symbol"), F.when(named, "EQ").alias("series"), F.col("c_name").alias("name"))


@query(with_views("""SELECT COALESCE(l.isin, l.symbol || '|' || l.series) AS identity, COALESCE(h.name, l.name) AS name, FALSE AS is_new FROM listed l LEFT JOIN (SELECT id, ARG_MAX(name, symbol || '|' || series) AS name FROM hit GROUP BY id) h ON h.id = l.security_id
 UNION ALL SELECT COALESCE(isin, symbol || '|' || series), ARG_MAX(name, symbol || '|' || series), TRUE FROM hit WHERE id IS NULL AND COALESCE(isin, symbol) IS NOT NULL GROUP BY 1""", _LISTED, _SEEN, """hit AS (SELECT s.*, LEAST(a.id, b.id) AS id FROM seen s
 LEFT JOIN (SELECT isin, MIN(security_id) AS id FROM listed WHERE isin IS NOT NULL GROUP BY 1) a ON a.isin = s.isin
 LEFT JOIN (SELECT symbol, series, MIN(security_id) AS id FROM listed WHERE isin IS NULL GROUP BY 1, 2) b ON b.symbol = s.symbol AND b.series = s.series)"""))  # fmt: skip
def master_after_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get or create by ISIN, or by symbol and series: the known security of least id takes the file's name, others get new ids."""
    own = listed(spark, sf_dir)
    last = own.agg(F.max("security_id")).first()[0] or 0
    rows = matching.get_or_create(own, seen(spark, sf_dir), ["name"])
    return rows.select(F.coalesce("isin", F.concat_ws("|", "symbol", "series")).alias("identity"), "name", (F.col("security_id") > last).alias("is_new"))


@query(with_views("""SELECT security_id, CASE WHEN exchange_tag = 'NSE' AND isin IN (SELECT isin FROM seen WHERE isin IS NOT NULL) THEN 'BOTH' ELSE exchange_tag END AS exchange_tag FROM listed""", _LISTED, _SEEN))
def listed_on_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.retagged(listed(spark, sf_dir), seen(spark, sf_dir)).select("security_id", "exchange_tag")


@query("""SELECT COALESCE(o.symbol, n.symbol) AS symbol, COALESCE(o.ex_date, n.ex_date) AS ex_date, COALESCE(n.amount, o.amount) AS amount, COALESCE(o.first_received, n.first_received) AS first_received
 FROM (SELECT l_partkey AS symbol, CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS ex_date, MAX(l_tax) AS amount, MIN(l_shipdate) AS first_received FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2) o
 FULL JOIN (SELECT l_partkey AS symbol, CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS ex_date, MAX(l_tax) AS amount, MIN(l_shipdate) AS first_received FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2) n
 ON o.symbol = n.symbol AND o.ex_date IS NOT DISTINCT FROM n.ex_date""")
def action_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions by a key with a nullable date: newer values win, the first day of receipt stays."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_returnflag")).alias("ex_date"), "l_tax", "l_shipdate", "l_linenumber")
    side = lambda part: part.groupBy("symbol", "ex_date").agg(F.max("l_tax").alias("amount"), F.min("l_shipdate").alias("first_received"))
    return upsert.merge_filled(side(rows.filter("l_linenumber < 4")), side(rows.filter("l_linenumber >= 3")), ["symbol", "ex_date"], keep_old=["first_received"])


@query("""SELECT o_orderkey AS news_id, CASE WHEN ok THEN old_id ELSE new_id END AS security_id, CASE WHEN ok OR new_id IS NULL THEN 'OLD' ELSE 'NEW' END AS match_method,
 CASE WHEN ok OR new_id IS NULL THEN 0.5 ELSE 0.9 END AS confidence, CASE WHEN ok THEN 'MAPPED' WHEN new_id IS NULL THEN status ELSE 'MAPPED' END AS mapping_status FROM (
 SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS old_id, CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' ELSE 'MAPPED' END AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey + 1 END AS new_id,
 o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AS ok FROM orders) x""")
def mappings_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valid mapping keeps its method and confidence when the cascade runs again."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    now = rows.select(key.alias("news_id"), F.when(key % 3 > 0, F.col("o_custkey")).alias("security_id"), F.lit("OLD").alias("match_method"), F.lit(0.5).alias("confidence"), F.when(key % 4 == 0, "PENDING").otherwise("MAPPED").alias("mapping_status"))
    found = rows.filter(key % 5 > 0).select(key.alias("news_id"), (F.col("o_custkey") + 1).alias("security_id"), F.lit("NEW").alias("match_method"), F.lit(0.9).alias("confidence"), F.lit("MAPPED").alias("mapping_status"))
    return matching.kept_mappings(now, found)


@query("""SELECT item, security_id, method, score, status, in_both, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item ORDER BY score DESC, security_id) AS rank FROM (
 SELECT COALESCE(a.item, b.item) AS item, COALESCE(a.id, b.id) AS security_id, CASE WHEN a.id IS NOT NULL THEN 'RULE' ELSE 'VECTOR_RAG' END AS method, COALESCE(a.score, b.score) AS score,
 CASE WHEN a.id IS NOT NULL THEN 'STRONG_CANDIDATE' ELSE 'NEEDS_REVIEW' END AS status, a.id IS NOT NULL AND b.id IS NOT NULL AS in_both
 FROM (SELECT l_suppkey AS item, l_partkey AS id, MAX(l_discount) AS score FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) a
 FULL JOIN (SELECT l_suppkey AS item, l_partkey AS id, MAX(l_tax) AS score FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2) b ON a.item = b.item AND a.id = b.id) x) y WHERE rank <= 20""")
def candidates_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of rules and of the vector search by security, the best twenty of each item.

    Rows are dealt once by the keys of the join, in four parts for each shuffle
    partition: aggregates and join stay on them, and Spark never makes fewer,
    larger tasks of them, in which both sides are sorted.
    """
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("security_id"), "l_discount", "l_tax", "l_linenumber")
    rows = rows.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "item", "security_id")
    fixed = rows.filter("l_linenumber <= 3").groupBy("item", "security_id").agg(F.max("l_discount").alias("score")).withColumns({"method": F.lit("RULE"), "status": F.lit("STRONG_CANDIDATE")})
    vectors = rows.filter("l_linenumber >= 3").groupBy("item", "security_id").agg(F.max("l_tax").alias("score"))
    return matching.merged_candidates(fixed, vectors)


_WANTED = """wanted AS (SELECT c_custkey AS group_id, CASE WHEN c_custkey % 3 = 0 THEN 'INE' || LPAD(CAST(c_custkey AS VARCHAR), 9, '0') END AS isin, CASE WHEN c_custkey % 2 = 0 THEN 'SYM' || CAST(c_custkey AS VARCHAR) END AS symbol,
 CASE WHEN c_custkey % 50 = 1 THEN 'small ring' END AS name FROM customer)"""


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("group_id"), F.when(key % 3 == 0, F.concat(F.lit("INE"), F.lpad(key.cast("string"), 9, "0"))).alias("isin"), F.when(key % 2 == 0, F.concat(F.lit("SYM"), key.cast("string"))).alias("symbol"), F.when(key % 50 == 1, "small ring").alias("name"))


@query(with_views("""SELECT group_id, security_id, STRING_AGG(rule, ',' ORDER BY rule) AS "by" FROM (SELECT group_id, security_id, 'ISIN' AS rule FROM wanted w JOIN listed l ON l.isin = w.isin UNION ALL SELECT group_id, security_id, 'SYMBOL' FROM wanted w JOIN listed l ON l.symbol = w.symbol
 UNION ALL SELECT group_id, security_id, 'NAME' FROM wanted w JOIN listed l ON UPPER(l.name) = UPPER(w.name)) x GROUP BY 1, 2""", _LISTED, _WANTED))  # fmt: skip
def canonical_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities that agree with a group in ISIN, symbol or name, and in which."""
    return matching.canonical_matches(wanted(spark, sf_dir), listed(spark, sf_dir))


@query("""SELECT group_id, n AS eligible, CASE WHEN n = 1 THEN 'MATCH' WHEN n > 1 THEN 'MULTIPLE_ELIGIBLE' ELSE 'NO_ELIGIBLE_CANDIDATE' END AS outcome, CASE WHEN n = 1 THEN id END AS security_id FROM (
 SELECT l_orderkey AS group_id, COUNT(*) FILTER (WHERE l_discount > 0.07) AS n, MIN(l_partkey) FILTER (WHERE l_discount > 0.07) AS id FROM lineitem GROUP BY 1) x""")
def single_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check ahead of any model: one eligible candidate decides by itself."""
    return matching.single_eligible(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("security_id"), (F.col("l_discount") > 0.07).alias("eligible")))


_EVENTS = """ev AS (SELECT news_id, news_id % 8 AS kind, CASE WHEN news_id // 8 % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, news_id * 7 % 200 AS t FROM news),
 sec AS (SELECT security_id, exchange, symbol, CASE WHEN security_id % 4 = 0 THEN 'ONLY ' || CAST(security_id AS VARCHAR) ELSE UPPER(name) END AS nm FROM listed WHERE security_id % 9 <> 0),
 cand AS (SELECT news_id, 1 AS r, 'EXISTING_ID' AS rule, 1.0 AS conf, security_id FROM ev JOIN sec ON kind = 0 AND security_id = t
 UNION ALL SELECT news_id, 2, 'CURATED_ALIAS', 1.0, security_id FROM ev JOIN sec ON kind = 1 AND security_id = t
 UNION ALL SELECT news_id, 3, 'SCRIP_CODE', 1.0, security_id FROM ev JOIN sec ON kind = 2 AND ev.exchange = 'BSE' AND security_id = t
 UNION ALL SELECT news_id, 4, 'SYMBOL', 0.98, security_id FROM ev JOIN sec ON kind = 3 AND sec.exchange = ev.exchange AND symbol = 'SYM' || CAST(t // 2 AS VARCHAR)
 UNION ALL SELECT news_id, 5, 'NAME', 0.9, security_id FROM ev JOIN sec ON sec.exchange = ev.exchange AND nm = CASE kind WHEN 4 THEN 'SMALL RING' WHEN 6 THEN 'ONLY ' || CAST(t // 4 * 4 AS VARCHAR) END
 UNION ALL SELECT news_id, 6, 'ALIAS', 0.88, security_id FROM ev JOIN sec ON kind = 5 AND security_id = t
 UNION ALL SELECT news_id, 7, 'CROSS_EXCHANGE', 0.85, security_id FROM ev JOIN sec ON nm = CASE kind WHEN 4 THEN 'SMALL RING' WHEN 6 THEN 'ONLY ' || CAST(t // 4 * 4 AS VARCHAR) END)"""


@query(with_views("""SELECT ev.news_id, CASE WHEN n = 1 THEN id END AS security_id, rule AS match_method, conf AS confidence, CASE WHEN n IS NULL THEN 'PENDING' WHEN n = 1 THEN 'MAPPED' ELSE 'AMBIGUOUS' END AS status FROM ev LEFT JOIN (
 SELECT c.news_id, c.rule, c.conf, COUNT(DISTINCT security_id) AS n, MIN(security_id) AS id FROM cand c JOIN (SELECT news_id, MIN(r) AS r FROM cand GROUP BY 1) f ON f.news_id = c.news_id AND f.r = c.r GROUP BY 1, 2, 3) x ON x.news_id = ev.news_id""", NEWS, _LISTED, _EVENTS))  # fmt: skip
def mapping_by_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven rules of the cascade with the exchanges on which they hold; every rule has events, and some names are ambiguous."""
    key = F.col("security_id")
    rows = listed(spark, sf_dir).filter(key % 9 != 0)
    securities = rows.select("security_id", "exchange", "symbol", (500000 + key).alias("scrip_code"), F.when(key % 4 == 0, F.concat(F.lit("Only "), key.cast("string"), F.lit(" Ltd"))).otherwise(F.col("name")).alias("name"))
    aliases = rows.select("security_id", F.concat(F.lit("Curated "), key.cast("string")).alias("alias"), F.lit(True).alias("curated")).unionByName(rows.select("security_id", F.concat(F.lit("Plain "), key.cast("string")).alias("alias"), F.lit(False).alias("curated")))
    item = F.col("news_id")
    kind, t = item % 8, item * 7 % 200
    text = t.cast("string")
    company = F.when(kind == 1, F.concat(F.lit("curated "), text)).when(kind == 4, "Small Ring Limited").when(kind == 5, F.concat(F.lit("PLAIN "), text)).when(kind == 6, F.concat(F.lit("only "), (F.floor(t / 4) * 4).cast("string")))
    events = news(spark, sf_dir).select("news_id", F.when(F.floor(item / 8) % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), F.when(kind == 0, t).alias("existing_id"), F.when(kind == 2, 500000 + t).alias("scrip_code"), F.when(kind == 3, F.concat(F.lit("sym"), F.floor(t / 2).cast("string"))).alias("symbol"), company.alias("company"))
    mapped = mapping.cascade(mapping.event_keys(events), mapping.exchange_keys(securities, aliases))
    none = events.select("news_id").join(mapped.select("news_id"), "news_id", "left_anti")
    return mapped.unionByName(none.withColumn("status", F.lit("PENDING")), allowMissingColumns=True)


_ASKED = """asked AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS security_id, CASE l_orderkey % 5 WHEN 0 THEN LOWER(m.isin) WHEN 1 THEN '  ' || m.symbol || ' ' WHEN 2 THEN REPLACE(m.instrument_name, ' ', '  ') WHEN 3 THEN m.bse_scrip_code ELSE 'nobody' END AS query_text
 FROM lineitem LEFT JOIN identities m ON m.security_id = l_partkey)"""
_IDENTITIES = """identities AS (SELECT security_id, isin, symbol, CASE WHEN security_id % 4 = 0 THEN symbol END AS nse_symbol, name AS instrument_name, CASE WHEN security_id % 3 = 0 THEN name END AS bse_name, CAST(500000 + security_id AS VARCHAR) AS bse_scrip_code, security_id % 17 > 0 AS is_active FROM listed)"""


@query(with_views("""SELECT id, CASE WHEN same IS NULL THEN 'NO_CANONICAL_MATCH' WHEN n > 0 THEN 'MATCH' ELSE 'REVIEW' END AS verdict,
 CASE WHEN n > 1 THEN 'MULTIPLE' WHEN n = 1 THEN ['ISIN', 'SYMBOL', 'NSE_SYMBOL', 'INSTRUMENT_NAME', 'BSE_NAME', 'BSE_SCRIP_CODE'][LIST_POSITION(same, TRUE)] END AS matched_field, COALESCE(12 - LEN(LIST_FILTER(same, LAMBDA x: x IS NOT NULL)), 12) AS unknown
 FROM (SELECT id, same, LEN(LIST_FILTER(same, LAMBDA x: x)) AS n FROM (SELECT a.id, CASE WHEN m.security_id IS NOT NULL THEN [UPPER(v) = UPPER(TRIM(REGEXP_REPLACE(a.query_text, ' +', ' ', 'g'))) FOR v IN [m.isin, m.symbol, m.nse_symbol, m.instrument_name, m.bse_name, m.bse_scrip_code]] END AS same
 FROM asked a LEFT JOIN identities m ON m.security_id = a.security_id AND m.is_active) q) r""", _LISTED, _IDENTITIES, _ASKED))  # fmt: skip
def candidates_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a search checked over twelve identity fields: the verdict, the field that proves it and how many could not be compared."""
    key = F.col("security_id")
    own = listed(spark, sf_dir).select(key, "isin", "symbol", F.when(key % 4 == 0, F.col("symbol")).alias("nse_symbol"), F.col("name").alias("instrument_name"), F.when(key % 3 == 0, F.col("name")).alias("bse_name"), (key + 500000).cast("string").alias("bse_scrip_code"), (key % 17 > 0).alias("is_active"))
    order = F.col("l_orderkey")
    text = F.when(order % 5 == 0, F.lower("isin")).when(order % 5 == 1, F.concat(F.lit("  "), "symbol", F.lit(" "))).when(order % 5 == 2, F.replace("instrument_name", F.lit(" "), F.lit("  "))).when(order % 5 == 3, F.col("bse_scrip_code")).otherwise("nobody")
    asked = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "security_id").join(own, "security_id", "left").select((order * 10 + F.col("l_linenumber")).alias("id"), "security_id", text.alias("query_text"))
    rows = matching.verified(asked, own)
    return rows.select("id", "verdict", "matched_field", F.size(F.filter("fields", lambda x: x["state"] == "UNKNOWN")).cast("long").alias("unknown"))


@query()
def similar_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar names of every part's name with a letter lost, among all names of its exchange."""
    name = F.upper(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "NSE").otherwise("BSE").alias("exchange"), name.alias("name"))
    at = (F.col("id") % F.length("name")).cast("int")
    lost = rows.withColumn("name", F.concat(F.substring("name", F.lit(1), at), F.substring("name", at + 2, F.length("name"))))
    return mapping.similar_names(lost, rows)
