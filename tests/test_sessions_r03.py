"""Features of sessions at events, in one run for each security (round 3, F13)."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from bourseline.operators import asof, series, sessions
from bourseline.plans import features

_BARS = "security_id long, trade_date date, open double, high double, low double, close double, volume double, turnover double"


def _made(spark):
    dice, first = random.Random(7), dt.date(2020, 1, 1)
    maybe = lambda x, share=0.05: None if dice.random() < share else x
    bars, events = [], []
    for s, n in ((1, 70), (2, 1), (4, 25), (5, 0), (7, 40)):
        days = sorted(dice.sample(range(120), n))
        bars += [(s, first + dt.timedelta(d), *(maybe(dice.uniform(5, 9)) for _ in range(4)), maybe(float(dice.choice([0, 0, 30, 50]))), dice.uniform(1, 2)) for d in days]
        events += [(1000 * s + i, s, maybe(first + dt.timedelta(dice.randrange(-5, 130)))) for i in range(60)]
    bars += [(9, first + dt.timedelta(d), 1.0, 1.0, 1.0, None, 1.0, 1.0) for d in range(3)]
    events += [(9000, 9, first + dt.timedelta(9)), (9001, 8, first)]
    return spark.createDataFrame(bars, _BARS), spark.createDataFrame(events, "news_id long, security_id long, cutoff date")


def test_features_at_events_are_those_of_the_windows(spark):
    bars, events = _made(spark)
    placed = asof.as_of(events, bars.select("security_id", "trade_date", "close"), "cutoff", ["close"]).drop("close").withColumnRenamed("base_date", "event_trade_date")
    own = series.session_features(bars).withColumnRenamed("trade_date", "event_trade_date")
    columns = ["news_id", "event_trade_date", "session", *[F.round(F.col(c), 9).alias(c) for c in features.NUMBERS]]
    expected = placed.join(own, ["security_id", "event_trade_date"], "left").select(*columns).orderBy("news_id").collect()
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7"):  # a security's bars and events then lie in many batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = sessions.at_events(events, bars, "cutoff", list(features.NUMBERS)).select(*columns).orderBy("news_id").collect()
            assert [tuple(r) for r in found] == [tuple(r) for r in expected]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_no_bars_no_events_and_events_without_a_security(spark):
    bars, events = _made(spark)
    assert sessions.at_events(events.limit(0), bars, "cutoff", ["close"]).count() == 0
    lone = events.unionByName(spark.createDataFrame([(1, None, dt.date(2020, 2, 2))], events.schema))
    found = sessions.at_events(lone, bars.limit(0), "cutoff", ["close"])
    assert found.count() == events.count()
    assert found.filter("event_trade_date IS NOT NULL OR session IS NOT NULL OR close IS NOT NULL").count() == 0


def test_event_feature_row_moves_no_row_of_a_session(spark):
    plan = features.event_feature_row(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "event_trade_date" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "SortMergeJoin" in x)
    assert "Window" not in plan


def test_training_evaluates_the_event_rows_once_and_gets_few_summaries(spark, monkeypatch):
    from bourseline.operators import boosting
    from bourseline.plans import learning

    calls = []
    monkeypatch.setattr(learning, "written", lambda rows, name: calls.append(rows) or __import__("bourseline.operators.lineage", fromlist=["x"]).written(rows, name))
    plan = learning.event_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert len(calls) == 1 and "MapInArrow" not in plan and "lineitem" not in plan
    seen = []
    frame = type(spark.range(1))
    kept = frame.agg
    monkeypatch.setattr(frame, "agg", lambda self, *a: seen.append(self.rdd.getNumPartitions()) or kept(self, *a))
    boosting.bins_of(spark.range(0, 1000, 1, 90).withColumn("a", F.col("id") * 1.5), ["a"])
    assert seen == [2 * spark.sparkContext.defaultParallelism]


def test_rows_without_a_label_are_scored_but_do_not_train(spark):
    from bourseline.operators import boosting

    rows = spark.range(400).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 40).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 40 < 20, "x").otherwise("y")).alias("label"))
    bins = boosting.bins_of(rows, ["a"])
    table = boosting.labelled_bins(rows, bins, "label", ["x", "y"], ["id"])
    assert table.count() == 400
    found = {r["id"]: (r["y_"], list(r["bins_"])) for r in table.collect()}
    for r in rows.collect():
        assert found[r["id"]] == ({"x": 0, "y": 1}.get(r["label"]), [0 if r["a"] is None else 1 + sum(e < r["a"] for e in bins.edges[0])])
    settings = boosting.Settings(rounds=3, rate=0.5, depth=2, columns=1.0, least_rows=5)
    model = boosting.fit(table.filter("y_ IS NOT NULL"), bins, ["x", "y"], settings)
    assert model.dumped() == boosting.fit(boosting.binned(rows, bins, "label", ["x", "y"]), bins, ["x", "y"], settings).dumped()
    said = {r["id"]: r["direction"] for r in boosting.predicted(table, model, ["id"]).collect()}
    assert len(said) == 400 and all(said[i] == ("x" if i % 40 < 20 else "y") for i in range(400) if i % 5)
