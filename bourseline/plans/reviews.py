"""Tables after batches of reviews, committed together and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reviews
from ..operators.lineage import fresh_path
from ..sources import versions
from .facades import MASTER, NEWS, master, news, table, with_views
from .registry import query

_EVENTS = """ev AS (SELECT news_id, CASE WHEN security_id % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, 'Company ' || CAST(security_id AS VARCHAR) AS company_name, mapping_status, CASE WHEN mapping_status = 'MAPPED' THEN security_id END AS security_id FROM news)"""
#: One line for each key: the given table repeats some.
_LINES = "lines AS (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)"
_REQUESTS = """rq AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_partkey % 10 = 0 THEN -l_orderkey ELSE l_orderkey END AS news_id, CASE WHEN l_partkey % 7 = 0 THEN -l_suppkey ELSE l_suppkey END AS security_id,
 CASE WHEN l_partkey % 3 = 0 THEN ' old  name ' || CAST(l_suppkey AS VARCHAR) WHEN l_partkey % 3 = 1 THEN '' END AS alias, 'user' || CAST(l_linenumber AS VARCHAR) AS reviewer FROM lines WHERE l_orderkey % 5 = 0 AND l_linenumber <= 2)"""
_ASKED = """ok AS (SELECT rq.*, ev.exchange, ev.company_name, COALESCE(LAG(rq.security_id) OVER w, ev.security_id) AS previous_security_id, CASE WHEN ROW_NUMBER() OVER w = 1 THEN ev.mapping_status ELSE 'MAPPED' END AS previous_status, ROW_NUMBER() OVER (PARTITION BY rq.news_id ORDER BY request_id DESC) AS back
 FROM rq JOIN ev ON ev.news_id = rq.news_id JOIN master m ON m.security_id = rq.security_id WINDOW w AS (PARTITION BY rq.news_id ORDER BY request_id))"""
_VIEWS = (NEWS, MASTER, _EVENTS, _LINES, _REQUESTS, _ASKED)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("security_id")
    mapped = F.col("mapping_status") == "MAPPED"
    return news(spark, sf_dir).select(
        "news_id", F.when(key % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), F.concat(F.lit("Company "), key.cast("string")).alias("company_name"), "mapping_status", F.when(mapped, "RULE").alias("mapping_method"), F.when(mapped, 0.9).alias("mapping_confidence"),
        F.lit(None).cast("string").alias("asset_category"), F.when(mapped, key).alias("security_id"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' mappings, some of unknown items or securities, with an alias, a blank one or none."""
    c = F.col
    rows = lines(spark, sf_dir).filter("l_orderkey % 5 = 0 AND l_linenumber <= 2")
    return rows.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("request_id"), F.when(c("l_partkey") % 10 == 0, -c("l_orderkey")).otherwise(c("l_orderkey")).alias("news_id"), F.when(c("l_partkey") % 7 == 0, -c("l_suppkey")).otherwise(c("l_suppkey")).alias("security_id"),
        F.when(c("l_partkey") % 3 == 0, F.concat(F.lit(" old  name "), c("l_suppkey").cast("string"))).when(c("l_partkey") % 3 == 1, "").alias("alias"), F.concat(F.lit("user"), c("l_linenumber").cast("string")).alias("reviewer"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of two runs on every item."""
    run = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = news(spark, sf_dir).select("news_id", "security_id", "published_at", run.alias("run_id"))
    n = F.col("news_id") + F.col("run_id")
    return rows.select(
        (F.col("news_id") * 10 + F.col("run_id")).alias("decision_id"), "run_id", "news_id", F.when(n % 3 > 0, "MATCH").otherwise("ABSTAIN").alias("decision"), F.when(n % 4 > 0, F.col("security_id")).alias("security_id"), (F.col("news_id") % 10 / 10.0).alias("confidence"),
        F.when(n % 2 == 0, '{"agent": "a", "manual_mapping": false}').alias("evidence"), F.lit("PENDING_REVIEW").alias("status"), F.lit(True).alias("requires_review"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("long").alias("final_security_id"),
        F.date_trunc("month", "published_at").alias("created_at"),
    )


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    """Root and newest version of the three tables after the users' mappings, written in one commit on top of the first."""
    root = fresh_path(spark, "reviews")
    known = [{"security_id": "long", "identity_type": "string", "identity_value": "string", "normalized_value": "string", "exchange": "string", "source": "string", "confidence": "double", "is_active": "boolean", "evidence": "string"}]
    none = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in known[0].items()))
    base = versions.commit(spark, root, 0, {"news": events(spark, sf_dir), "identities": none, "decisions": decisions(spark, sf_dir)})
    number, now = versions.latest(spark, root)
    old = {t: versions.read(spark, root, now, t) for t in ("news", "identities", "decisions")}
    securities = master(spark, sf_dir).select("security_id", F.lit("EQUITY").alias("asset_category"))
    after = reviews.manual_mapping(old["news"], old["identities"], old["decisions"], securities, requests(spark, sf_dir))
    versions.commit(spark, root, base, dict(zip(("news", "identities", "decisions", "refused"), after, strict=True)))
    return root, versions.latest(spark, root)[1]


@query(with_views("""SELECT ev.news_id, COALESCE(ok.security_id, ev.security_id) AS security_id, CASE WHEN ok.news_id IS NULL THEN ev.mapping_status ELSE 'MAPPED' END AS mapping_status, CASE WHEN ok.news_id IS NOT NULL THEN 'USER_CONFIRMED' WHEN ev.mapping_status = 'MAPPED' THEN 'RULE' END AS mapping_method,
 CASE WHEN ok.news_id IS NOT NULL THEN 'EQUITY' END AS asset_category FROM ev LEFT JOIN ok ON ok.news_id = ev.news_id AND ok.back = 1""", *_VIEWS))
def news_after_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, now = _mapped(spark, sf_dir)
    return versions.read(spark, root, now, "news").select("news_id", "security_id", "mapping_status", "mapping_method", "asset_category")


@query(with_views("""SELECT security_id, exchange, normalized_value, ARG_MAX(news_id, request_id) AS news_id, ARG_MAX(reviewer, request_id) AS reviewer, ARG_MAX(previous_status, request_id) AS previous_status, ARG_MAX(COALESCE(CAST(previous_security_id AS VARCHAR), 'none'), request_id) AS previous_security_id
 FROM (SELECT *, UPPER(REGEXP_REPLACE(TRIM(COALESCE(NULLIF(alias, ''), company_name)), ' +', ' ', 'g')) AS normalized_value FROM ok) x GROUP BY 1, 2, 3""", *_VIEWS))
def identities_after_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, now = _mapped(spark, sf_dir)
    told = lambda name: F.get_json_object("evidence", f"$.{name}")
    return versions.read(spark, root, now, "identities").select("security_id", "exchange", "normalized_value", told("news_id").cast("long").alias("news_id"), told("reviewer").alias("reviewer"), told("previous_status").alias("previous_status"), F.coalesce(told("previous_security_id"), F.lit("none")).alias("previous_security_id"))


_DECISIONS = """dc AS (SELECT news_id * 10 + r AS decision_id, r AS run_id, news_id, CASE WHEN (news_id + r) % 3 > 0 THEN 'MATCH' ELSE 'ABSTAIN' END AS decision, CASE WHEN (news_id + r) % 4 > 0 THEN security_id END AS security_id, (news_id + r) % 2 = 0 AS told, DATE_TRUNC('month', published_at) AS created_at FROM news, (VALUES (1), (2)) v(r))"""


@query(with_views("""SELECT dc.decision_id, CASE WHEN ok.news_id IS NULL THEN 'PENDING_REVIEW' ELSE 'USER_CONFIRMED' END AS status, ok.reviewer AS reviewed_by, ok.news_id IS NULL AS requires_review, CASE WHEN dc.told THEN 'a' END AS agent,
 CASE WHEN ok.news_id IS NOT NULL THEN 'true' WHEN dc.told THEN 'false' END AS manual_mapping, CAST(ok.security_id AS VARCHAR) AS confirmed FROM dc LEFT JOIN ok ON ok.news_id = dc.news_id AND ok.back = 1 AND dc.decision = 'MATCH'""", *_VIEWS, _DECISIONS))
def decisions_after_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, now = _mapped(spark, sf_dir)
    told = lambda name: F.get_json_object("evidence", f"$.{name}")
    return versions.read(spark, root, now, "decisions").select("decision_id", "status", "reviewed_by", "requires_review", told("agent").alias("agent"), told("manual_mapping").alias("manual_mapping"), told("user_confirmed_security_id").alias("confirmed"))


@query(with_views("""SELECT request_id, CASE WHEN m.security_id IS NULL THEN 'SECURITY_NOT_FOUND' ELSE 'NEWS_NOT_FOUND' END AS reason FROM rq LEFT JOIN ev ON ev.news_id = rq.news_id LEFT JOIN master m ON m.security_id = rq.security_id WHERE ev.news_id IS NULL OR m.security_id IS NULL""", *_VIEWS))
def refused_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, now = _mapped(spark, sf_dir)
    return versions.read(spark, root, now, "refused")


_VERDICTS = """vd AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_partkey % 10 = 0 THEN -l_orderkey ELSE l_orderkey END AS news_id, CASE l_partkey % 4 WHEN 0 THEN ' correct' WHEN 1 THEN 'WRONG' WHEN 2 THEN 'maybe' ELSE 'Correct' END AS verdict FROM lines WHERE l_linenumber <= 2),
 nw AS (SELECT news_id, decision_id FROM dc QUALIFY ROW_NUMBER() OVER (PARTITION BY news_id ORDER BY created_at DESC, decision_id DESC) = 1),
 la AS (SELECT nw.decision_id, ARG_MAX(UPPER(TRIM(verdict)), request_id) AS outcome FROM vd JOIN nw ON nw.news_id = vd.news_id WHERE UPPER(TRIM(verdict)) IN ('CORRECT', 'WRONG') GROUP BY 1)"""


@query(with_views("""SELECT dc.decision_id, CASE WHEN la.outcome IS NULL THEN 'PENDING_REVIEW' ELSE 'USER_REVIEWED' END AS status, la.outcome, CASE WHEN dc.told THEN 'a' END AS agent FROM dc LEFT JOIN la ON la.decision_id = dc.decision_id""", NEWS, _DECISIONS, _LINES, _VERDICTS))
def decisions_after_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the newest decision of each item, merged into its evidence."""
    c = F.col
    verdict = F.when(c("l_partkey") % 4 == 0, " correct").when(c("l_partkey") % 4 == 1, "WRONG").when(c("l_partkey") % 4 == 2, "maybe").otherwise("Correct")
    asked = lines(spark, sf_dir).filter("l_linenumber <= 2").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("request_id"), F.when(c("l_partkey") % 10 == 0, -c("l_orderkey")).otherwise(c("l_orderkey")).alias("news_id"), verdict.alias("verdict"), F.lit(None).cast("string").alias("wrong_reason"), F.lit("seen").alias("comment"), F.lit("user").alias("reviewer"),
    )
    told = lambda name: F.get_json_object("evidence", f"$.{name}")
    return reviews.agent_feedback(decisions(spark, sf_dir), asked)[0].select("decision_id", "status", told("review_outcome").alias("outcome"), told("agent").alias("agent"))


@query(with_views("""SELECT ev.news_id, COALESCE(ev.security_id, f.security_id) AS security_id, CASE WHEN ev.security_id IS NULL AND f.security_id IS NOT NULL THEN 'MAPPED' ELSE ev.mapping_status END AS mapping_status, CASE WHEN ev.security_id IS NULL AND f.security_id IS NOT NULL THEN 'AGENT' WHEN ev.mapping_status = 'MAPPED' THEN 'RULE' END AS mapping_method
 FROM ev LEFT JOIN (SELECT news_id, ARG_MIN(security_id, decision_id) AS security_id FROM dc WHERE decision = 'MATCH' AND security_id IS NOT NULL GROUP BY 1) f ON f.news_id = ev.news_id""", NEWS, _EVENTS, _DECISIONS))
def news_after_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items after the agent's matches are applied at an accuracy over the threshold."""
    return reviews.apply_matches(events(spark, sf_dir), decisions(spark, sf_dir), 0.95)[0].select("news_id", "security_id", "mapping_status", "mapping_method")


@query("""SELECT outcome, COUNT(*) AS n FROM (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'PREDICTION_NOT_FOUND' WHEN o.o_custkey <> c THEN 'NEWS_DIFFERS' ELSE 'REVIEWED' END AS outcome FROM
 (SELECT CASE WHEN l_partkey % 9 = 0 THEN -l_orderkey ELSE l_orderkey END AS k, l_orderkey, l_partkey FROM lineitem) l LEFT JOIN orders o ON o.o_orderkey = l.k LEFT JOIN (SELECT o_orderkey, o_custkey AS c FROM orders) p ON p.o_orderkey = l.l_orderkey - CASE WHEN l_partkey % 8 = 0 THEN 1 ELSE 0 END) x GROUP BY 1""")
def checked_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback whose prediction is known and of the same item, and what is refused."""
    c = F.col
    predictions = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("prediction_id"), c("o_custkey").alias("news_id"))
    keys = table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("request_id"), F.when(c("l_partkey") % 9 == 0, -c("l_orderkey")).otherwise(c("l_orderkey")).alias("prediction_id"), (c("l_orderkey") - F.when(c("l_partkey") % 8 == 0, 1).otherwise(0)).alias("k"),
    )
    asked = keys.join(predictions.select(c("prediction_id").alias("k"), "news_id"), "k", "left").drop("k")
    good, refused = reviews.checked_feedback(predictions, asked)
    return good.select(c("review_status").alias("outcome")).unionByName(refused.select(c("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))
