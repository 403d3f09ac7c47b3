"""Boosted trees of three classes on planted rules."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bourseline.operators import boosting, learning

CLASSES = list(learning.CLASSES)
FAST = boosting.Settings(rounds=4, rate=0.5, depth=2, columns=1.0, least_rows=20, keep=2)


@pytest.fixture(scope="module")
def rows(spark):
    """Three of seven categories or a missing number tell NEGATIVE, a large number POSITIVE; every tenth label is NEUTRAL."""
    made = spark.range(4000).select(
        "id", F.expr("date_add(DATE '2020-01-01', CAST(id DIV 10 AS INT))").alias("day"), (F.hash("id", F.lit(1)) % 1000 / 100.0).alias("a"), F.when(F.col("id") % 5 > 0, F.hash("id", F.lit(2)) % 1000 / 100.0).alias("b"), (F.col("id") % 7).cast("int").alias("c"), F.lit(1.0).alias("same"),
    )
    rule = F.when(F.col("c").isin(1, 4) | F.col("b").isNull(), "NEGATIVE").when(F.col("a") > 3, "POSITIVE").otherwise("NEUTRAL")
    return made.withColumn("label", F.when(F.col("id") % 10 == 3, "NEUTRAL").otherwise(rule)).cache()


@pytest.fixture(scope="module")
def trained(rows):
    bins = boosting.bins_of(rows, ["a", "b", "c", "same"], ["c"])
    table = boosting.binned(rows, bins, "label", CLASSES)
    return bins, table, boosting.fit(table, bins, CLASSES, FAST)


def test_rules_are_learned_and_probabilities_hold(rows, trained):
    out = boosting.scored(rows, trained[2], ["id", "label"]).collect()
    assert len(out) == 4000
    assert all(abs(r["p_negative"] + r["p_neutral"] + r["p_positive"] - 1) < 1e-9 and r["score"] == max(r["p_negative"], r["p_neutral"], r["p_positive"]) == r[f"p_{r['direction'].lower()}"] for r in out)
    right = sum(r["label"] == r["direction"] for r in out) / 4000
    majority = max(sum(r["label"] == c for r in out) for c in CLASSES) / 4000
    assert right > 0.85 > majority + 0.2


def test_model_does_not_depend_on_partitions_or_on_when_margins_are_kept(trained):
    bins, table, model = trained
    assert boosting.fit(table.repartition(7), bins, CLASSES, boosting.Settings(**{**FAST.__dict__, "keep": 100})).dumped() == model.dumped()


def test_first_split_is_the_best_of_all(rows, trained):
    """The root of the first NEGATIVE tree against every cut by brute force, categories by their sets."""
    bins, _, model = trained
    data = rows.select("a", "b", "c", "label").toPandas()
    y = (data["label"] == "NEGATIVE").to_numpy()
    p = y.mean()
    g, h = p - y, p * (1 - p) * 1.5
    score = lambda m: max(abs(g[m].sum()) - 0.1, 0) ** 2 / (h * m.sum() + 0.1)
    coded = boosting.Bins(["a", "b", "c"], bins.edges[:3], ["c"]).of(data)
    cuts = []
    for f in range(2):
        for at in range(1, 65):
            for missing in (True, False):
                cuts.append((coded[:, f] <= at) & ((coded[:, f] > 0) | missing))
    ranked = sorted(range(1, 8), key=lambda b: g[coded[:, 2] == b].sum())
    cuts += [(coded[:, 2][:, None] == ranked[:n]).any(axis=1) for n in range(1, 7)]
    best = max(score(m) + score(~m) for m in cuts if 20 <= m.sum() <= len(y) - 20)
    tree = model.trees[0][0]
    left = (coded[:, tree.feature[0]][:, None] == tree.left[0]).any(axis=1)
    assert abs(score(left) + score(~left) - best) < 1e-2


def test_stored_model_scores_alike(spark, rows, trained, tmp_path):
    boosting.save(spark, trained[2], f"file://{tmp_path}/m")
    again = boosting.load(spark, f"file://{tmp_path}/m")
    assert again.dumped() == trained[2].dumped()
    assert boosting.importance(spark, again).first()["importance"] > 0
    assert {r["feature"]: r["importance"] for r in boosting.importance(spark, again).collect()}["same"] == 0


def test_empty_and_unlabelled_tables_give_equal_classes(spark, rows):
    none = rows.withColumn("label", F.lit(None).cast("string"))
    bins = boosting.bins_of(rows.limit(0), ["a", "c"], ["c"])
    model = boosting.fit(boosting.binned(none, bins, "label", CLASSES), bins, CLASSES, FAST)
    assert [round(boosting.scored(rows.limit(1), model, ["id"]).first()[f"p_{c.lower()}"], 6) for c in CLASSES] == [0.333333] * 3


def test_too_many_categories(rows):
    with pytest.raises(ValueError, match="categories"):
        boosting.bins_of(rows, ["id"], ["id"])


def test_experiments_share_one_table_and_show_what_a_feature_gives(rows):
    start = date(2020, 1, 1)
    plan = [(1, start + timedelta(200), start + timedelta(202), start + timedelta(260)), (2, start + timedelta(260), start + timedelta(262), start + timedelta(320))]
    got = learning.experiments(rows, {"all": ["a", "b", "c"], "without_c": ["a", "b"]}, "label", plan, categories=["c"], settings=boosting.Settings(**{**FAST.__dict__, "rounds": 2})).cache()
    assert sorted((r["experiment"], r["fold"], r["train_rows"], r["test_rows"]) for r in got.collect()) == [("all", 1, 2010, 580), ("all", 2, 2610, 580), ("without_c", 1, 2010, 580), ("without_c", 2, 2610, 580)]
    delta = {r["experiment"]: r["delta_macro_f1"] for r in learning.experiment_summary(got, "all").collect()}
    assert delta["all"] == 0 > delta["without_c"]
