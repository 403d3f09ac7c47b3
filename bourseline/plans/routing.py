"""News routing, mapping to securities, audits and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as M
from ..functions import text as T
from ..operators import mapping, upsert, vector_index
from ..operators.asof import counted_between
from ..operators.lineage import fresh_path
from .facades import ACTIONS, BARS, MASTER, NEWS, bars, master, news, quantized, table, with_views
from .registry import query

#: News titles made from the facade, so that every rule of the cascade has rows.
_TITLED = """titled AS (SELECT n.news_id, n.security_id AS existing_id, n.mapping_status, n.category, n.published_at,
 CASE news_id % 6 WHEN 0 THEN 'SUPPLIER ' || LPAD(CAST(n.security_id AS VARCHAR), 9, '0') || ' Ltd (' || CAST(500000 + n.security_id AS VARCHAR) || ')'
 WHEN 1 THEN 'SYM' || CAST(n.security_id AS VARCHAR) || ' : Company has informed the Exchange' WHEN 2 THEN 'Supplier ' || LPAD(CAST(n.security_id AS VARCHAR), 9, '0')
 WHEN 3 THEN 'SEBI turnover fees for members' WHEN 4 THEN 'Daily Bulletin' ELSE 'Unknown Holdings Limited' END AS title FROM news n)"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News with a title in one of the shapes that feeds use."""
    number = F.lpad(F.col("security_id").cast("string"), 9, "0")
    kind = F.col("news_id") % 6
    title = (
        F.when(kind == 0, F.concat(F.lit("SUPPLIER "), number, F.lit(" Ltd ("), (500000 + F.col("security_id")).cast("string"), F.lit(")")))
        .when(kind == 1, F.concat(F.lit("SYM"), F.col("security_id").cast("string"), F.lit(" : Company has informed the Exchange")))
        .when(kind == 2, F.concat(F.lit("Supplier "), number))
        .when(kind == 3, "SEBI turnover fees for members")
        .when(kind == 4, "Daily Bulletin")
        .otherwise("Unknown Holdings Limited")
    )
    return news(spark, sf_dir).select("news_id", F.col("security_id").alias("existing_id"), "mapping_status", "category", "published_at", title.alias("title"))


@query(with_views("""SELECT news_id, NULLIF(REGEXP_EXTRACT(title, '\\(([0-9]{5,8})\\)', 1), '') AS scrip_code, NULLIF(REGEXP_EXTRACT(title, '^\\s*([A-Z0-9&-]{1,20})\\s*:', 1), '') AS symbol,
 CASE WHEN news_id % 6 = 0 THEN 'SUPPLIER ' || LPAD(CAST(existing_id AS VARCHAR), 9, '0') || ' Ltd' WHEN news_id % 6 = 1 THEN 'Company' ELSE title END AS company FROM titled""", NEWS, _TITLED))  # fmt: skip
def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return titled(spark, sf_dir).select("news_id", T.scrip_code(title).alias("scrip_code"), T.title_symbol(title).alias("symbol"), T.title_company(title).alias("company"))


@query(with_views("""SELECT news_id, CASE WHEN title IN ('SEBI turnover fees for members', 'Daily Bulletin') AND category IN ('1-URGENT', '2-HIGH') THEN 'MARKET' ELSE 'STOCK' END AS news_scope,
 CASE WHEN title IN ('SEBI turnover fees for members', 'Daily Bulletin') AND category IN ('1-URGENT', '2-HIGH') THEN 'NOT_APPLICABLE' ELSE 'PENDING' END AS mapping_status,
 CASE WHEN title IN ('SEBI turnover fees for members', 'Daily Bulletin') AND category IN ('1-URGENT', '2-HIGH') THEN 0.99 END AS confidence FROM titled
 WHERE NOT (category IN ('1-URGENT', '2-HIGH') AND title NOT IN ('SEBI turnover fees for members', 'Daily Bulletin'))
 UNION ALL SELECT news_id, CASE WHEN news_id % 6 IN (0, 5) THEN 'UNKNOWN' ELSE 'MARKET' END, CASE WHEN news_id % 6 IN (0, 5) THEN 'UNMAPPED' ELSE 'NOT_APPLICABLE' END, CASE WHEN news_id % 6 NOT IN (0, 5) THEN 0.95 END FROM titled
 WHERE category IN ('1-URGENT', '2-HIGH') AND title NOT IN ('SEBI turnover fees for members', 'Daily Bulletin') AND news_id % 6 <> 1
 UNION ALL SELECT news_id, 'UNKNOWN', 'UNMAPPED', NULL FROM titled WHERE category IN ('1-URGENT', '2-HIGH') AND news_id % 6 = 1""", NEWS, _TITLED))  # fmt: skip
def notice_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope and status by the ordered notice rules; the two urgent categories stand for notices."""
    rows = titled(spark, sf_dir).withColumn("category", F.when(F.col("category").isin("1-URGENT", "2-HIGH"), "NOTICES").otherwise(F.col("category")))
    scope, status, confidence = mapping.notice_rules(F.col("category"), F.col("title"), F.col("title"))
    return rows.select("news_id", scope.alias("news_scope"), status.alias("mapping_status"), confidence.alias("confidence"))


@query(with_views("""SELECT t.news_id, COALESCE(c.security_id, s.security_id, n.security_id) AS security_id,
 CASE WHEN c.security_id IS NOT NULL THEN 'SCRIP_CODE' WHEN s.security_id IS NOT NULL THEN 'SYMBOL' WHEN n.security_id IS NOT NULL THEN 'NAME' END AS match_method,
 CASE WHEN c.security_id IS NOT NULL THEN 1.0 WHEN s.security_id IS NOT NULL THEN 0.98 WHEN n.security_id IS NOT NULL THEN 0.9 END AS confidence,
 CASE WHEN COALESCE(c.security_id, s.security_id, n.security_id) IS NULL THEN 'PENDING' ELSE 'MAPPED' END AS status
 FROM titled t LEFT JOIN master c ON t.news_id % 6 = 0 AND c.is_active AND c.security_id = t.existing_id LEFT JOIN master s ON t.news_id % 6 = 1 AND s.is_active AND s.security_id = t.existing_id
 LEFT JOIN master n ON t.news_id % 6 = 2 AND n.is_active AND n.security_id = t.existing_id""", NEWS, MASTER, _TITLED))  # fmt: skip
def mapping_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item mapped by the first rule that finds a security: scrip code, symbol, name; several of one rule are ambiguous."""
    keys = mapping.security_keys(master(spark, sf_dir).filter("is_active").withColumn("scrip_code", 500000 + F.col("security_id")))
    return mapping.cascade(mapping.news_keys(titled(spark, sf_dir)), keys).select("news_id", "security_id", "match_method", "confidence", "status")


@query("""SELECT item_id, other_key, shared FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY shared DESC, other_key) AS n FROM (
 SELECT x.item_id, y.other_key, COUNT(*) AS shared FROM (SELECT DISTINCT item_id, UNNEST(STRING_SPLIT(LOWER(text), ' ')) AS t FROM benchmark) x
 JOIN (SELECT DISTINCT conv_id * 1000 + turn AS other_key, UNNEST(STRING_SPLIT(LOWER(text), ' ')) AS t FROM conversations) y ON x.t = y.t GROUP BY 1, 2) q) z WHERE n <= 5""")  # fmt: skip
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each text by shared tokens, over an inverted index."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token")
    left = table(spark, sf_dir, "benchmark").select("item_id", words)
    right = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("other_key"), words).distinct()
    return mapping.shared_tokens(left.distinct(), right, "item_id", "other_key", 5)


_GATE = """gate AS (SELECT s_suppkey AS event_id, s_suppkey % 7 = 0 AS isin_same, s_suppkey % 5 = 0 AS isin_other, s_suppkey % 3 = 0 AS symbol_same, s_suppkey % 2 = 0 AS exchange_same, (s_suppkey % 100) / 100.0 AS similarity FROM supplier)"""


@query(with_views("""SELECT event_id, CASE WHEN isin_other AND NOT isin_same THEN 'REJECT' WHEN isin_same OR (symbol_same AND exchange_same) THEN 'MATCH_ELIGIBLE'
 WHEN similarity >= 0.85 AND exchange_same THEN 'MATCH_ELIGIBLE' ELSE 'ABSTAIN' END AS decision,
 CASE WHEN isin_other AND NOT isin_same THEN 'ISIN_MISMATCH' WHEN isin_same OR (symbol_same AND exchange_same) THEN 'STRONG_IDENTIFIER'
 WHEN similarity >= 0.85 AND exchange_same THEN 'STRONG_NAME_AND_EXCHANGE' END AS reason FROM gate""", _GATE))  # fmt: skip
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence gate over event and candidate fields."""
    key = F.col("s_suppkey")
    other, same = key % 5 == 0, key % 7 == 0
    rows = table(spark, sf_dir, "supplier").select(
        key.alias("event_id"),
        F.when(same | other, F.lit("INE000000001")).alias("event_isin"),
        F.when(same, F.lit("INE000000001")).when(other, F.lit("INE000000002")).alias("isin"),
        F.when(key % 3 == 0, F.lit("SYM")).alias("event_symbol"),
        F.when(key % 3 == 0, F.lit("SYM")).alias("symbol"),
        F.lit("NSE").alias("event_exchange"),
        F.when(key % 2 == 0, "NSE").otherwise("BSE").alias("exchange"),
        ((key % 100) / 100.0).alias("similarity"),
    )
    decision, reason = mapping.evidence_gate("event_isin", "isin", "event_symbol", "symbol", "event_exchange", "exchange", "similarity")
    return rows.select("event_id", decision.alias("decision"), reason.alias("reason"))


@query(with_views("""SELECT news_id, CASE WHEN mapping_status <> 'MAPPED' THEN 'NOT_MAPPED' WHEN n_rows = 0 THEN 'NO_HISTORY' WHEN n_rows < 20 THEN 'INSUFFICIENT_HISTORY'
 WHEN news_id % 4 = 0 THEN 'FEATURES_MISSING' WHEN news_id % 4 = 1 THEN 'PREDICTION_PENDING' ELSE 'SCORED' END AS reason,
 CASE WHEN mapping_status <> 'MAPPED' THEN 'MAPPING' WHEN n_rows < 20 THEN 'PIT' WHEN news_id % 4 = 0 THEN 'FEATURES' ELSE 'SCORING' END AS last_stage FROM (
 SELECT w.news_id, w.mapping_status, COUNT(b.trade_date) AS n_rows FROM news w LEFT JOIN bars b ON b.security_id = w.security_id AND b.trade_date BETWEEN
 CAST(published_at AS DATE) - CASE WHEN CAST(published_at AS TIME) > TIME '15:30:00' THEN 0 ELSE 1 END - 140 AND CAST(published_at AS DATE) - CASE WHEN CAST(published_at AS TIME) > TIME '15:30:00' THEN 0 ELSE 1 END
 GROUP BY 1, 2) x""", BARS, NEWS))  # fmt: skip
def pipeline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an item stands where it does, and the last stage it reached."""
    rows = news(spark, sf_dir).select("news_id", "security_id", "published_at", "mapping_status", M.prediction_cutoff(F.col("published_at")).alias("cutoff"))
    rows = counted_between(rows, bars(spark, sf_dir), "cutoff", 140)
    has = rows.withColumns({"news_scope": F.lit("STOCK"), "has_features": F.col("news_id") % 4 != 0, "eligible": F.lit(True), "is_scored": F.col("news_id") % 4 > 1})
    reason, stage = mapping.audit_reason()
    return has.select("news_id", reason.alias("reason")).select("news_id", "reason", stage.alias("last_stage"))


@query(with_views("""SELECT mapping_status, category, COUNT(*) AS n, COUNT(*) FILTER (WHERE security_id IS NOT NULL) AS with_security, MAX(published_at) AS last_published FROM news GROUP BY 1, 2""", NEWS))
def news_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).groupBy("mapping_status", "category").agg(F.count("*").alias("n"), F.count("security_id").alias("with_security"), F.max("published_at").alias("last_published"))


@query(with_views("""SELECT COUNT(*) AS news_items, COUNT(DISTINCT security_id) AS securities, COUNT(DISTINCT CASE WHEN mapping_status = 'MAPPED' THEN security_id END) AS mapped_securities,
 (SELECT COUNT(*) FROM bars) AS price_rows, (SELECT COUNT(*) FROM actions) AS actions, (SELECT COUNT(*) FROM master WHERE is_active) AS active_securities FROM news""", NEWS, BARS, ACTIONS, MASTER))  # fmt: skip
def pipeline_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent global counts side by side; each side is one row."""
    rows = news(spark, sf_dir)
    out = rows.agg(F.count("*").alias("news_items"), F.countDistinct("security_id").alias("securities"), F.countDistinct(F.when(F.col("mapping_status") == "MAPPED", F.col("security_id"))).alias("mapped_securities"))
    sides = [bars(spark, sf_dir).agg(F.count("*").alias("price_rows")), rows.agg(F.count("*").alias("actions")), master(spark, sf_dir).filter("is_active").agg(F.count("*").alias("active_securities"))]
    for side in sides:
        out = out.join(F.broadcast(side))
    return out


@query(with_views("""SELECT n.news_id, n.published_at, n.category, m.symbol, m.instrument_name FROM news n LEFT JOIN master m ON m.security_id = n.security_id
 WHERE m.symbol ILIKE '%7%' OR m.instrument_name ILIKE '%7%' OR n.category ILIKE '%7%' ORDER BY n.published_at DESC NULLS LAST, n.news_id DESC LIMIT 50 OFFSET 100""", NEWS, MASTER))  # fmt: skip
def news_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty matches of a search, newest first."""
    rows = news(spark, sf_dir).join(master(spark, sf_dir).select("security_id", "symbol", "instrument_name"), "security_id", "left")
    hit = F.col("symbol").ilike("%7%") | F.col("instrument_name").ilike("%7%") | F.col("category").ilike("%7%")
    return rows.filter(hit).orderBy(F.desc_nulls_last("published_at"), F.desc("news_id")).offset(100).limit(50).select("news_id", "published_at", "category", "symbol", "instrument_name")


@query(with_views("""SELECT CASE WHEN mapping_status = 'PENDING' THEN 'EXCEPTIONS' WHEN category IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'EQUITY' ELSE 'NON_EQUITY' END AS bucket, COUNT(*) AS n FROM news GROUP BY 1""", NEWS))
def feed_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each feed bucket by status, then asset category."""
    asset = F.when(F.col("category").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "EQUITY").otherwise("OTHER")
    return news(spark, sf_dir).groupBy(mapping.feed_bucket(F.col("mapping_status"), asset).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, e.user_id, CASE WHEN p.event_id IS NULL THEN 'MISSING' ELSE 'STALE' END AS state FROM events e LEFT JOIN (SELECT event_id, FLOOR(value) AS v FROM events WHERE event_id % 3 <> 0) p
 ON p.event_id = e.event_id WHERE p.event_id IS NULL OR (CASE WHEN e.event_id % 10 = 1 THEN FLOOR(e.value) + 1 ELSE FLOOR(e.value) END) IS DISTINCT FROM p.v""")
def missing_or_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose derived row is absent or was made from other values."""
    now = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 10 == 1, F.floor("value") + 1).otherwise(F.floor("value")).alias("v"))
    derived = table(spark, sf_dir, "events").filter("event_id % 3 <> 0").select("event_id", F.floor("value").alias("v"))
    return mapping.missing_or_stale(now, derived, ["event_id"], ["v"]).select("event_id", "user_id", "state")


@query("""SELECT o_orderkey AS news_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber IN (1, 5, 10))""")
def unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a prediction on any horizon."""
    scored = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber").isin(1, 5, 10)).select(F.col("l_orderkey").alias("news_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("news_id")).join(scored, "news_id", "left_anti")


@query("""SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("""SELECT occurrences, COUNT(*) AS securities FROM (SELECT l_suppkey, COUNT(*) AS occurrences FROM lineitem GROUP BY 1) x GROUP BY 1""")
def counts_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("occurrences")).groupBy("occurrences").agg(F.count("*").alias("securities"))


@query("""SELECT COUNT(*) FILTER (WHERE quality = 1) AS correct, COUNT(*) FILTER (WHERE quality = 0) AS wrong, CASE WHEN COUNT(quality) > 0 THEN FLOOR(COUNT(*) FILTER (WHERE quality = 1) * 1e4 / COUNT(quality) + 0.5) / 1e4 END AS accuracy,
 COUNT(*) FILTER (WHERE quality IS NULL) AS unreviewed FROM labels""")
def review_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed items that were right; null without a review."""
    right, n = F.count_if(F.col("quality") == 1), F.count("quality")
    return table(spark, sf_dir, "labels").agg(right.alias("correct"), F.count_if(F.col("quality") == 0).alias("wrong"), F.when(n > 0, F.floor(right * F.lit(1e4) / n + 0.5) / 1e4).alias("accuracy"), F.count_if(F.col("quality").isNull()).alias("unreviewed"))


@query(with_views("""SELECT o.news_id, CASE WHEN r IS NULL THEN 'NOT_ENOUGH_DATA' WHEN (p = 'POSITIVE' AND r >= 0.75) OR (p = 'NEGATIVE' AND r <= -0.75) THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS assessment,
 CASE WHEN r IS NULL THEN NULL WHEN (p = 'POSITIVE' AND r <= -0.75) OR (p = 'NEGATIVE' AND r >= 0.75) THEN 'CONTRADICTORY_MARKET_REACTION' WHEN (p = 'POSITIVE' AND r >= 0.75) OR (p = 'NEGATIVE' AND r <= -0.75) THEN NULL ELSE 'UNKNOWN' END AS reason
 FROM (SELECT news_id, CASE news_id % 3 WHEN 0 THEN 'POSITIVE' WHEN 1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS p, CASE WHEN news_id % 11 > 0 THEN (news_id % 401 - 200) / 100.0 END AS r FROM news) o""", NEWS))  # fmt: skip
def outcome_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news(spark, sf_dir).select("news_id", F.when(F.col("news_id") % 3 == 0, "POSITIVE").when(F.col("news_id") % 3 == 1, "NEGATIVE").otherwise("NEUTRAL").alias("p"), F.when(F.col("news_id") % 11 > 0, (F.col("news_id") % 401 - 200) / 100.0).alias("r"))
    return rows.select("news_id", M.outcome_v1(F.col("p"), F.col("r")).alias("assessment"), M.outcome_reason_v1(F.col("p"), F.col("r")).alias("reason"))


@query(with_views("""SELECT category, COUNT(*) FILTER (WHERE mapping_status = 'MAPPED') AS MAPPED, COUNT(*) FILTER (WHERE mapping_status = 'PENDING') AS PENDING FROM news GROUP BY 1""", NEWS))
def impact_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross counts; the pivot's values are given, so no job runs to find them."""
    return news(spark, sf_dir).groupBy("category").pivot("mapping_status", ["MAPPED", "PENDING"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT a.vec_id, b.vec_id AS neighbour, FLOOR(LIST_DOT_PRODUCT(a.e, b.e) / SQRT(LIST_DOT_PRODUCT(a.e, a.e)) / SQRT(LIST_DOT_PRODUCT(b.e, b.e)) * 1e4 + 0.5) / 1e4 AS cosine
 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id
 QUALIFY ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY FLOOR(LIST_DOT_PRODUCT(a.e, b.e) / SQRT(LIST_DOT_PRODUCT(a.e, a.e)) / SQRT(LIST_DOT_PRODUCT(b.e, b.e)) * 1e4 + 0.5) DESC, b.vec_id) <= 10""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by cosine of every query (ids divisible by 100) against all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return mapping.nearest(rows.filter("vec_id % 100 = 0"), rows, 10).select("vec_id", "neighbour", quantized(F.col("score")).alias("cosine"))


def _identity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


def _security_hits(hits: DataFrame, securities: DataFrame) -> DataFrame:
    """Vector hits by security: the greatest cosine, how many identities were hit, name and exchange of the master where it knows the security."""
    per = hits.groupBy("vec_id", (F.col("neighbour") % 100).alias("security_id")).agg(F.max("score").alias("best"), F.count("*").alias("identity_hits"))
    return per.join(securities.select("security_id", "instrument_name", "exchange_tag"), "security_id", "left").select("vec_id", "security_id", "instrument_name", "exchange_tag", quantized(F.col("best")).alias("best_cosine"), "identity_hits")


@query(with_views("""SELECT h.vec_id, h.security_id, m.instrument_name, m.exchange_tag, h.best_cosine, h.identity_hits FROM (SELECT vec_id, neighbour % 100 AS security_id, MAX(cosine) AS best_cosine, COUNT(*) AS identity_hits FROM (
 SELECT a.vec_id, b.vec_id AS neighbour, FLOOR(LIST_DOT_PRODUCT(a.e, b.e) / SQRT(LIST_DOT_PRODUCT(a.e, a.e)) / SQRT(LIST_DOT_PRODUCT(b.e, b.e)) * 1e4 + 0.5) / 1e4 AS cosine
 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id
 QUALIFY ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY cosine DESC, b.vec_id) <= 10) n GROUP BY 1, 2) h LEFT JOIN master m ON m.security_id = h.security_id""", MASTER))
def vector_index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities by the ten nearest identity vectors of every query, from a stored index with all cells probed, which is exact."""
    rows = _identity_vectors(spark, sf_dir)
    index = vector_index.build(rows, fresh_path(spark, "identities"))
    hits = vector_index.search(index, rows.filter("vec_id % 100 = 0"), 10, len(index.centres))
    return _security_hits(hits, master(spark, sf_dir))


@query()
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every query (ids divisible by 100) from the cells that a recall of 0.95 asks for.

    The number of cells is measured with other vectors as queries (the 64 of least hash).
    """
    rows = _identity_vectors(spark, sf_dir)
    index = vector_index.build(rows, fresh_path(spark, "identities"))
    probes = vector_index.probes_for(index, rows.filter("vec_id % 100 <> 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(64), 10)
    found = vector_index.search(index, rows.filter("vec_id % 100 = 0"), 10, probes)
    return found.select("vec_id", "neighbour", quantized(F.col("score")).alias("cosine"))


@query("""SELECT id, origin, priority FROM (SELECT o_custkey AS id, 'ORDER' AS origin, 0 AS priority FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'MASTER', 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) x""")
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two sources; of rows with one key that of the first source stays."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("ORDER").alias("origin"), F.lit(0).alias("priority"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("MASTER").alias("origin"), F.lit(1).alias("priority"))
    return a.unionByName(b).groupBy("id").agg(F.min_by("origin", "priority").alias("origin"), F.min("priority").alias("priority"))


@query("""SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def requested_minus_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("""SELECT c_custkey AS security_id, CASE WHEN c_custkey % 3 = 0 THEN 'BOTH' WHEN c_custkey <= 1000 THEN 'NSE' ELSE 'BSE' END AS tag,
 CASE WHEN c_custkey <= 1000 THEN c_mktsegment ELSE 'NEW' END AS category FROM customer WHERE c_custkey <= 1000 OR c_custkey % 3 = 0 OR c_custkey % 3 = 1""")
def master_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known securities keep their category and are retagged; unknown ones are added."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("security_id"), "c_mktsegment")
    known = rows.filter("security_id <= 1000").select("security_id", F.lit("NSE").alias("tag"), F.col("c_mktsegment").alias("category"))
    seen = rows.filter("security_id % 3 = 0 OR (security_id > 1000 AND security_id % 3 = 1)").select("security_id", F.when(F.col("security_id") % 3 == 0, "BOTH").otherwise("BSE").alias("tag"), F.lit("NEW").alias("category"))
    return upsert.merge_filled(known, seen, ["security_id"], keep_old=["category"])


@query("""SELECT user_id, event_type, MAX(ts) AS ts, COUNT(*) AS arrivals FROM events GROUP BY 1, 2""")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert target after all arrivals: the newest row of every key, and how many arrived."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.count("*").alias("arrivals"))


@query("""SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 2 = 1 AND event_id % 5 = 0""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target with the even ids after inserting every fifth, known keys ignored."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return upsert.insert_ignore(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 5 = 0"), ["event_id"], [F.col("user_id")])
