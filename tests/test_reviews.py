"""One commit for several tables, and batches of reviews."""

import json

import pytest
from pyspark.sql import functions as F

from bourseline.operators import reviews
from bourseline.sources import versions


def tables(spark, n):
    return {"a": spark.range(n).select("id"), "b": spark.range(n).select((F.col("id") * 2).alias("id"))}


def counts(spark, root):
    number, now = versions.latest(spark, root)
    return number, {t: versions.read(spark, root, now, t).count() for t in now}


def folders(path, table):
    return len([x for x in (path / "r" / table).iterdir() if x.is_dir()])


def test_commits_follow_each_other_and_keep_unnamed_tables(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    assert versions.latest(spark, root) == (0, {})
    assert versions.commit(spark, root, 0, tables(spark, 3)) == 1
    assert versions.commit(spark, root, 1, {"b": spark.range(7)}) == 2
    assert counts(spark, root) == (2, {"a": 3, "b": 7})


def test_failed_writer_leaves_all_tables(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    versions.commit(spark, root, 0, tables(spark, 3))
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        versions.commit(spark, root, 1, {"a": spark.range(9), "b": broken})
    assert counts(spark, root) == (1, {"a": 3, "b": 3})
    assert folders(tmp_path, "a") == folders(tmp_path, "b") == 1


def test_of_two_writers_of_one_base_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    versions.commit(spark, root, 0, tables(spark, 3))
    versions.commit(spark, root, 1, {"a": spark.range(4)})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, 1, {"a": spark.range(5), "b": spark.range(5)})
    assert counts(spark, root) == (2, {"a": 4, "b": 3}) and folders(tmp_path, "b") == 1


def test_writer_that_is_overtaken_while_it_writes(spark, tmp_path, monkeypatch):
    """The other commit comes after the check of the base and before the manifest."""
    root = f"file://{tmp_path}/r"
    versions.commit(spark, root, 0, tables(spark, 3))
    publish = versions._publish

    def overtaken(session, where, version, text):
        monkeypatch.setattr(versions, "_publish", publish)
        versions.commit(session, where, 1, {"a": session.range(8)})
        publish(session, where, version, text)

    monkeypatch.setattr(versions, "_publish", overtaken)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, 1, {"a": spark.range(5), "b": spark.range(5)})
    assert counts(spark, root) == (2, {"a": 8, "b": 3}) and folders(tmp_path, "b") == 1


NEWS = "news_id long, exchange string, company_name string, mapping_status string, mapping_method string, mapping_confidence double, asset_category string, security_id long"
IDENTITIES = "security_id long, identity_type string, identity_value string, normalized_value string, exchange string, source string, confidence double, is_active boolean, evidence string"
DECISIONS = "decision_id long, news_id long, decision string, security_id long, confidence double, evidence string, status string, requires_review boolean, reviewed_by string, final_security_id long, created_at timestamp"


def test_manual_mapping_twice_for_one_item(spark):
    news = spark.createDataFrame([(1, "NSE", "Acme  Ltd", "PENDING", None, None, None, None), (2, None, None, "AMBIGUOUS", None, None, None, None)], NEWS)
    known = spark.createDataFrame([(7, "ALIAS", "AcMe Ltd", "ACME LTD", "NSE", "RULE", 0.5, False, None)], IDENTITIES)
    decisions = spark.createDataFrame([(1, 1, "MATCH", 5, 0.9, "not json", "X", True, None, None, None), (2, 1, "ABSTAIN", None, None, None, "X", True, None, None, None), (3, 2, "MATCH", 5, 0.9, '{"k": null}', "X", True, None, None, None)], DECISIONS)
    master = spark.createDataFrame([(7, "EQUITY"), (8, None)], "security_id long, asset_category string")
    asked = spark.createDataFrame([(1, 1, 8, "x", "u"), (2, 1, 7, None, "v"), (3, 2, 7, " ", "w"), (4, 9, 7, None, "u"), (5, 1, 9, None, "u"), (6, None, None, None, None)], "request_id long, news_id long, security_id long, alias string, reviewer string")
    after, identities, decided, refused = reviews.manual_mapping(news, known, decisions, master, asked)
    assert sorted((r["news_id"], r["security_id"], r["mapping_status"], r["asset_category"]) for r in after.collect()) == [(1, 7, "MAPPED", "EQUITY"), (2, 7, "MAPPED", "EQUITY")]
    rows = {(r["security_id"], r["normalized_value"]): r for r in identities.collect()}
    assert set(rows) == {(7, "ACME LTD"), (8, "X")}
    assert rows[7, "ACME LTD"]["identity_value"] == "AcMe Ltd" and rows[7, "ACME LTD"]["is_active"] and rows[7, "ACME LTD"]["source"] == "USER_CONFIRMED"
    assert json.loads(rows[7, "ACME LTD"]["evidence"]) == {"news_id": 1, "previous_status": "MAPPED", "previous_security_id": 8, "reviewer": "v"}
    got = {r["decision_id"]: r for r in decided.collect()}
    assert (got[1]["status"], got[2]["status"], got[1]["security_id"]) == ("USER_CONFIRMED", "X", 5)
    assert json.loads(got[1]["evidence"]) == {"user_confirmed_security_id": 7, "previous_security_id": 8, "manual_mapping": True}
    assert json.loads(got[3]["evidence"]) == {"k": None, "user_confirmed_security_id": 7, "previous_security_id": None, "manual_mapping": True}
    assert sorted((r["request_id"], r["reason"]) for r in refused.collect()) == [(4, "NEWS_NOT_FOUND"), (5, "SECURITY_NOT_FOUND"), (6, "SECURITY_NOT_FOUND")]


def test_feedback_takes_the_newest_decision_and_nested_evidence_stays(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 1L, '{\"e\": {\"x\": [1, 2]}}', TIMESTAMP '2020-01-02', 'X', true, null), (2L, 1L, null, TIMESTAMP '2020-01-01', 'X', true, null), (3L, 2L, null, null, 'X', true, null) AS t(decision_id, news_id, evidence, created_at, status, requires_review, reviewed_by)")
    asked = spark.createDataFrame([(1, 1, "wrong", "r", None, "u"), (2, 1, " Correct ", None, "c", "v"), (3, 2, None, None, None, "u"), (4, 5, "CORRECT", None, None, "u")], "request_id long, news_id long, verdict string, wrong_reason string, comment string, reviewer string")
    after, refused = reviews.agent_feedback(rows, asked)
    got = {r["decision_id"]: r for r in after.collect()}
    assert json.loads(got[1]["evidence"]) == {"e": {"x": [1, 2]}, "review_outcome": "CORRECT", "wrong_reason": None, "comment": "c"}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["USER_REVIEWED", "X", "X"]
    assert sorted((r["request_id"], r["reason"]) for r in refused.collect()) == [(3, "BAD_VERDICT"), (4, "NO_DECISION")]


def test_matches_wait_for_the_accuracy_and_take_open_items_only(spark):
    news = spark.createDataFrame([(1, "NSE", "a", "PENDING", None, None, None, None), (2, "NSE", "b", "MAPPED", "RULE", 0.9, None, 3), (3, "NSE", "c", "UNMAPPED", None, None, None, None)], NEWS)
    decisions = spark.createDataFrame([(i, n, "MATCH", 5, 0.8, None, "P", True, None, None, None) for i, n in ((1, 1), (2, 2), (3, 3))] + [(4, 1, "MATCH", 6, 0.9, None, "P", True, None, None, None), (5, 1, "MATCH", None, 0.9, None, "P", True, None, None, None)], DECISIONS)
    assert all(reviews.apply_matches(news, decisions, a)[0] is news for a in (None, 0.89))
    after, decided = reviews.apply_matches(news, decisions, 0.9)
    assert sorted((r["news_id"], r["security_id"], r["mapping_status"]) for r in after.collect()) == [(1, 5, "MAPPED"), (2, 3, "MAPPED"), (3, None, "UNMAPPED")]
    assert {r["decision_id"]: (r["status"], r["final_security_id"]) for r in decided.collect()} == {1: ("AUTO_APPLIED", 5), 2: ("AUTO_APPLIED", 5), 3: ("AUTO_APPLIED", 5), 4: ("AUTO_APPLIED", 6), 5: ("P", None)}


def test_feedback_needs_its_parent(spark):
    parents = spark.createDataFrame([(1, 10), (2, 20), (2, 20)], "prediction_id long, news_id long")
    asked = spark.createDataFrame([(1, 1, 10), (2, 2, 21), (3, 9, 10), (4, None, 10), (5, 2, 20)], "request_id long, prediction_id long, news_id long")
    good, refused = reviews.checked_feedback(parents, asked)
    assert sorted(r["request_id"] for r in good.collect()) == [1, 5]
    assert sorted((r["request_id"], r["reason"]) for r in refused.collect()) == [(2, "NEWS_DIFFERS"), (3, "PREDICTION_NOT_FOUND"), (4, "PREDICTION_NOT_FOUND")]
