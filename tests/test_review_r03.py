"""Findings of the third review: each test failed before its change."""

import math
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from bourseline.operators import mapping, matching, reviews, series
from bourseline.plans import registry, reports

DATA = "/root/testdata/sf0.001"


def from_sql(name, folder):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.execute(registry.ORACLE_SQL[name]).fetchall()


def test_feedback_without_a_news_item_contradicts_nothing(spark, tmp_path):
    """Orders with a gap before their first key: the item of the key before is unknown."""
    table = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    table("orders").withColumn("o_orderkey", F.col("o_orderkey") + 1000).write.parquet(f"{tmp_path}/orders.parquet")
    lines = table("lineitem").withColumn("l_orderkey", F.when(F.col("l_orderkey") < 50, 1000).otherwise(F.col("l_orderkey") + 1000))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for t in ("part", "customer", "supplier", "nation", "region"):
        table(t).write.parquet(f"{tmp_path}/{t}.parquet")
    got = {r["outcome"]: r["n"] for r in registry.QUERIES["checked_feedback"](spark, str(tmp_path)).collect()}
    assert got == dict(from_sql("checked_feedback", tmp_path))
    parents = spark.createDataFrame([(1, 10), (2, None)], "prediction_id long, news_id long")
    asked = spark.createDataFrame([(1, 1, None), (2, 2, 20), (3, 1, 11)], "request_id long, prediction_id long, news_id long")
    good, refused = reviews.checked_feedback(parents, asked)
    assert sorted(r["request_id"] for r in good.collect()) == [1, 2] and [tuple(r) for r in refused.collect()] == [(3, "NEWS_DIFFERS")]


def most_joined(spark, frame):
    """The rows of a frame and the most rows that one join made for them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = frame.collect()
    most = 0
    for i in range(before, store.executionsCount()):
        run = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            for m in (n.metrics().apply(j) for j in range(n.metrics().size())):
                if "Join" in n.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return rows, most


def test_a_key_of_many_securities_multiplies_no_items(spark):
    keys = spark.range(300).selectExpr("'NAME' AS rule", "'HOT' AS key", "id AS security_id").union(spark.sql("SELECT 'SYMBOL', 'ONE', 7L"))
    wanted = spark.range(200).selectExpr("id AS news_id", "'NAME' AS rule", "'HOT' AS key").union(spark.sql("SELECT 500L, 'SYMBOL', 'ONE'"))
    rows, most = most_joined(spark, mapping.cascade(wanted, keys))
    assert {(r["news_id"], r["status"], r["security_id"]) for r in rows} == {(i, "AMBIGUOUS", None) for i in range(200)} | {(500, "MAPPED", 7)}
    assert 0 < most <= 201


def test_announcements_end_where_their_sql_ends(spark, monkeypatch):
    values = [("b", 4), ("a", 2), (None, 9), ("b", 3), ("a", 1), ("b", 5), (None, 8)]
    rows = spark.createDataFrame(values, "shown string, id long")
    order = [("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5), (None, 8), (None, 9)]
    for n in (0, 1, 2, 4, 6, 7, 99):
        assert {tuple(r) for r in reports.first_rows(rows, "shown", "id", n).collect()} == set(order[:n])
    whole = [tuple(r) for r in registry.QUERIES["announcement_table"](spark, DATA).collect()]
    monkeypatch.setattr(reports, "ANNOUNCEMENTS", 10)
    assert [tuple(r) for r in registry.QUERIES["announcement_table"](spark, DATA).collect()] == whole[:10] and len(whole) > 10


def test_names_meet_in_blocks_and_not_by_pairs_of_letters(spark):
    rows, most = most_joined(spark, registry.QUERIES["similar_part_names"](spark, DATA))
    assert len(rows) > 100 and 0 < most <= 2 * len(rows)


def test_matches_of_a_shared_name_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "KEY_BLOCK", 8)
    schema = "isin string, symbol string, name string"
    wanted = [(i, f"I{i}", None if i % 2 else "S1", " ring") for i in range(40)] + [(3, "I3", "s7", "ring"), (3, "I4", None, "Cap"), (None, "I9", "S1", None)]
    listed = [(i, f"i{i % 20}", f"S{i % 9}", "Ring " if i % 3 else "cap") for i in range(50)] + [(7, "I3", "s7", "cap"), (None, "I9", None, "ring")]
    a, b = spark.createDataFrame(wanted, f"group_id long, {schema}"), spark.createDataFrame(listed, f"security_id long, {schema}")
    plain = lambda x: x.strip().upper() if x else None
    want = {}
    for g, *x in wanted:
        for s, *y in listed:
            want.setdefault((g, s), set()).update(n for n, p, q in zip(("ISIN", "SYMBOL", "NAME"), x, y, strict=True) if p and q and plain(p) == plain(q))
    got = [tuple(r) for r in matching.canonical_matches(a, b).collect()]
    assert len(got) == len({r[:2] for r in got}) and {r[:2]: r[2] for r in got} == {k: ",".join(sorted(v)) for k, v in want.items() if v}
    plan = matching.canonical_matches(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "ia_" in plan and "collect_set(by" not in plan


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(mapping, "QUERY_BLOCK", 3)
    monkeypatch.setattr(mapping, "ROW_BLOCK", 7)
    dice = random.Random(1)
    rows = [(i, [dice.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, e array<double>")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)) if a and b and len(a) == len(b) else None
    want = set()
    for i, a in rows[::5]:
        order = sorted((c is None, -math.floor((c or 0) * 1e4 + 0.5), j, c) for j, b in rows if j != i for c in [cosine(a, b)])
        want |= {(i, j, c) for _, _, j, c in order[:4]}
    rows, most = most_joined(spark, mapping.nearest(frame.filter("vec_id % 5 = 0"), frame, 4))
    assert {tuple(r) for r in rows} == want and len(rows) == 13 * 4
    assert most <= 13 * 62 // 2


def test_slices_do_not_move_through_a_shuffle(spark):
    days = [(s, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(s * 1000 + i)) for s in (1, 2) for i in range(30)]
    bars = spark.createDataFrame(days, "security_id long, d string, close double").selectExpr("security_id", "CAST(d AS DATE) AS trade_date", "close")
    events = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 1, 9), (4, 2, 30), (5, 2, 31), (6, 3, 10), (7, 1, None)], "news_id long, security_id long, session int")
    rows, most = most_joined(spark, series.slices(events, bars, 10))
    assert {r["news_id"]: r["closes"] for r in rows} == {i: [float(s * 1000 + j) for j in range(n - 10, n)] for i, s, n in ((1, 1, 10), (2, 1, 10), (4, 2, 30))}
    assert len(rows) == 3 and most == 0


def test_a_security_is_made_plain_once_and_not_for_each_candidate(spark):
    master = spark.createDataFrame([(1, "IN 1", " a  b ", True), (2, "x", "x", True), (3, "y", None, False)], "security_id long, isin string, symbol string, is_active boolean")
    asked = spark.createDataFrame([(1, "in  1"), (1, "A b"), (2, "X"), (2, None), (3, "y"), (4, "z")], "security_id long, query_text string")
    rows = matching.verified(asked, master)
    assert [(r["verdict"], r["matched_field"]) for r in rows.collect()].count(("MATCH", "MULTIPLE")) == 1
    assert {(r["security_id"], r["query_text"], r["verdict"], r["matched_field"]) for r in rows.collect()} == {(1, "in  1", "MATCH", "ISIN"), (1, "A b", "MATCH", "SYMBOL"), (2, "X", "MATCH", "MULTIPLE"), (2, None, "REVIEW", None), (3, "y", "NO_CANONICAL_MATCH", None), (4, "z", "NO_CANONICAL_MATCH", None)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("Join LeftOuter")].count("regexp_replace") <= 1
