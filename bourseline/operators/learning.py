"""Folds, training, scoring and metrics for three-class direction models with MLlib."""

from __future__ import annotations

import json
from datetime import date
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting

CLASSES = ("NEGATIVE", "NEUTRAL", "POSITIVE")


def _month(day: date, ahead: int = 0) -> date:
    n = day.year * 12 + day.month - 1 + ahead
    return date(n // 12, n % 12 + 1, 1)


def folds(rows: DataFrame, day: str, test_months: int = 2, train_months: int = 6, train_days: int = 60, last: int = 5, least: int = 3) -> list[tuple[int, date, date, date]]:
    """(fold, last training day, first test day, first day after the test): expanding windows over the distinct days.

    Training ends one session before the last one ahead of the test. The days
    of a calendar are few at any number of rows.
    """
    days = [r[0] for r in rows.select(day).distinct().orderBy(day).collect() if r[0] is not None]
    found = []
    if days:
        start = _month(days[0], train_months)
        while _month(start, test_months) <= _month(days[-1], 1):
            end = _month(start, test_months)
            before = [d for d in days if d < start]
            if len(before) > train_days and any(start <= d < end for d in days):
                found.append((before[-2], start, end))
            start = end
    found = found[-last:]
    if len(found) < least:
        raise ValueError(f"{len(found)} folds; at least {least} are needed")
    return [(i + 1, *f) for i, f in enumerate(found)]


def tagged(rows: DataFrame, plan: list[tuple[int, date, date, date]], day: str = "day") -> DataFrame:
    """Every row once for each fold that uses it, with ``fold`` and ``part`` (train or test)."""
    table = F.broadcast(rows.sparkSession.createDataFrame(plan, "fold int, train_end date, test_start date, test_end date"))
    part = F.when(F.col(day) <= F.col("train_end"), "train").when((F.col(day) >= F.col("test_start")) & (F.col(day) < F.col("test_end")), "test")
    return rows.join(table).withColumn("part", part).filter("part IS NOT NULL").drop("train_end", "test_start", "test_end")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_report(counts: DataFrame) -> DataFrame:
    """label, support, recall, precision, f1 of every class that has rows."""
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    own = counts.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hits"))
    said = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    rows = own.join(said, "label", "left")
    recall, precision = F.col("hits") / F.col("support"), F.coalesce(F.try_divide(F.col("hits"), F.col("said")), F.lit(0.0))
    return rows.select("label", "support", recall.alias("recall"), precision.alias("precision"), F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)).alias("f1"))


def summary(counts: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy, macro_f1 in one row."""
    return class_report(counts).agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def scored(rows: DataFrame, features: list[str], label: str, train: Column, trees: int = 20, depth: int = 6, key: str = "news_id") -> DataFrame:
    """key, three probabilities, direction and score for all rows; the model is fitted on labelled training rows.

    MLlib's boosted trees have two classes only, so a forest stands for the three-class model. Missing features count as 0.
    """
    index = F.when(F.col(label) == CLASSES[0], 0.0).when(F.col(label) == CLASSES[1], 1.0).when(F.col(label) == CLASSES[2], 2.0)
    ready = VectorAssembler(inputCols=features, outputCol="features_").transform(rows.withColumn("y_", index).na.fill(0, features))
    model = RandomForestClassifier(featuresCol="features_", labelCol="y_", numTrees=trees, maxDepth=depth, seed=1).fit(ready.filter(train & F.col("y_").isNotNull()))
    p = vector_to_array("probability")
    out = model.transform(ready).select(key, *[p[i].alias(f"p_{c.lower()}") for i, c in enumerate(CLASSES)])
    each = F.array(*[F.col(f"p_{c.lower()}") for c in CLASSES])
    best = F.array_max(each)
    return out.withColumn("direction", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(each, best).cast("int"))).withColumn("score", best)


def ablation(rows: DataFrame, groups: dict[str, list[str]], label: str, train: Column) -> DataFrame:
    """accuracy, balanced accuracy and macro F1 on the other rows for each set of features, and the difference to the first."""
    out = None
    for name, features in groups.items():
        own = scored(rows, features, label, train).join(rows.filter(~train).select("news_id", label), "news_id")
        one = summary(confusion(own.select(F.col(label).alias("label"), F.col("direction").alias("predicted")))).withColumn("experiment", F.lit(name))
        out = one if out is None else out.unionByName(one)
    base = out.filter(F.col("experiment") == next(iter(groups))).select(F.col("macro_f1").alias("base_"))
    return out.join(F.broadcast(base)).withColumn("delta", F.col("macro_f1") - F.col("base_")).drop("base_")


def experiments(rows: DataFrame, groups: dict[str, list[str]], label: str, plan: list[tuple[int, date, date, date]], day: str = "day", categories: list[str] = (), settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """experiment, fold, train_rows, test_rows, accuracy, balanced_accuracy, macro_f1: boosted trees for each set of features and fold.

    All features are binned once, by bounds of the first fold's training days,
    so no fold sees a later day; each experiment asks its own features of that
    one table.  Folds and experiments are a short stated list.
    """
    every = checked_features(list(dict.fromkeys(f for features in groups.values() for f in features)))
    bins = boosting.bins_of(rows.filter(F.col(day) <= min(p[1] for p in plan)), every, categories)
    table = boosting.binned(rows, bins, label, list(CLASSES), [day])
    out = []
    for fold, train_end, test_start, test_end in plan:
        train = table.filter(F.col(day) <= F.lit(train_end))
        test = table.filter((F.col(day) >= F.lit(test_start)) & (F.col(day) < F.lit(test_end)))
        for name, features in groups.items():
            model = boosting.fit(train, bins, list(CLASSES), settings, features)
            said = boosting.predicted(test, model, ["y_"])
            one = summary(confusion(said.select(F.element_at(F.array(*map(F.lit, CLASSES)), F.col("y_") + 1).alias("label"), F.col("direction").alias("predicted"))))
            sizes = train.agg(F.count("*").alias("train_rows")).join(test.agg(F.count("*").alias("test_rows")))
            out.append(one.join(sizes).select(F.lit(name).alias("experiment"), F.lit(fold).alias("fold"), "train_rows", "test_rows", "accuracy", "balanced_accuracy", "macro_f1"))
    return reduce(DataFrame.unionByName, out)


def experiment_summary(metrics: DataFrame, base: str) -> DataFrame:
    """experiment, folds, mean and sample deviation of each metric over the folds, and the mean difference of macro F1 to ``base`` in the same fold."""
    reference = metrics.filter(F.col("experiment") == base).select("fold", F.col("macro_f1").alias("base_"))
    stats = [f(c).alias(f"{n}_{c}") for c in ("accuracy", "balanced_accuracy", "macro_f1") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return metrics.join(F.broadcast(reference), "fold", "left").groupBy("experiment").agg(F.count("*").alias("folds"), *stats, F.avg(F.col("macro_f1") - F.col("base_")).alias("delta_macro_f1"))


#: The value that stands for a missing category (fixed value).
MISSING = "__MISSING__"
#: Columns that are no features (fixed values): identifiers, times, future returns and directions, label and eligibility flags.
NO_FEATURES = (
    "news_id", "security_id",
    "event_trade_date", "published_at", "prediction_cutoff_ts", "cutoff_trade_date", "created_at", "updated_at",
    "forward_return_1d", "forward_return_3d", "forward_return_5d", "forward_return_10d",
    "direction_1d", "direction_3d", "direction_5d", "direction_10d",
    "has_1d_label", "has_3d_label", "has_5d_label", "has_10d_label",
    "prediction_eligible", "prediction_note",
)
#: Names that the label queries of this library give to what comes after an item.
OWN_LABELS = ("label", "return_1d", "return_3d", "return_5d", "return_10d")


def vocabulary(rows: DataFrame, column: str) -> list[str]:
    """The categories of the whole table and the one for missing values, sorted; categories are few at any number of rows."""
    found = rows.select(F.coalesce(column, F.lit(MISSING)).alias("v")).distinct().collect()
    return sorted({r["v"] for r in found} | {MISSING})


def coded(rows: DataFrame, column: str, words: list[str], code: str) -> DataFrame:
    """The place of each row's category in the vocabulary; a category outside it raises when its row is computed."""
    place = F.array_position(F.array(*map(F.lit, words)), F.coalesce(F.col(column), F.lit(MISSING)))
    bad = F.raise_error(F.concat(F.lit(f"unseen value of {column}: "), F.col(column)))
    return rows.withColumn(code, F.when(place > 0, (place - 1).cast("int")).otherwise(bad))


def checked_features(features: list[str], allowed: tuple[str, ...] = ()) -> list[str]:
    """The features if none of them tells the future or names a row; else ValueError. Backward returns are features."""
    bad = [f for f in features if f not in allowed and f.lower() in (*NO_FEATURES, *OWN_LABELS)]
    if bad or len(set(features)) != len(features):
        raise ValueError(f"features that leak or repeat: {bad or features}")
    return features


def chronological(rows: DataFrame, day: str, first_test: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the first day of the test, and those from it on; no day is in both by construction."""
    cut = F.lit(first_test).cast("date")
    return rows.filter(F.col(day) < cut), rows.filter(F.col(day) >= cut)


def majority_metrics(train: DataFrame, test: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy, macro_f1 on the test of always predicting the training rows' most frequent label."""
    modal = train.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("predicted"))
    return summary(confusion(test.join(F.broadcast(modal)).select("label", "predicted")))


def fold_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean, std (sample), least, greatest over folds; one row for each metric."""
    stats = metrics.agg(*[F.struct(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("greatest")).alias(c) for c in columns])
    return stats.select(F.explode(F.array(*columns)).alias("m")).select("m.*")


def fit(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 6) -> RandomForestClassificationModel:
    """A forest of the three classes on labelled rows; missing features count as 0."""
    index = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(label)) - 1
    ready = VectorAssembler(inputCols=checked_features(features), outputCol="features_").transform(rows.filter(F.col(label).isin(*CLASSES)).withColumn("y_", index.cast("double")).na.fill(0, features))
    return RandomForestClassifier(featuresCol="features_", labelCol="y_", numTrees=trees, maxDepth=depth, seed=1).fit(ready)


def importance(spark, model: RandomForestClassificationModel, features: list[str]) -> DataFrame:
    """feature, importance from the greatest on."""
    rows = list(zip(features, (float(x) for x in model.featureImportances.toArray()), strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(spark, model: RandomForestClassificationModel, features: list[str], metrics: dict[str, float], path: str) -> None:
    """Model, order of its features, metrics and importance under one path of a shared store."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(features), json.dumps(metrics))], "features string, metrics string").coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    importance(spark, model, features).coalesce(1).write.mode("overwrite").csv(f"{path}/importance", header=True)


def score_stored(spark, path: str, rows: DataFrame, key: str = "news_id") -> DataFrame:
    """key, probabilities, direction and score by a stored model; the order of features is the model's, a missing one raises."""
    features = json.loads(spark.read.schema("features string, metrics string").json(f"{path}/metrics").first()["features"])
    if lost := [f for f in features if f not in rows.columns]:
        raise ValueError(f"features are missing: {lost}")
    model = RandomForestClassificationModel.load(f"{path}/model")
    out = model.transform(VectorAssembler(inputCols=features, outputCol="features_").transform(rows.na.fill(0, features)))
    each = vector_to_array("probability")
    best = F.array_max(each)
    return out.select(key, *[each[i].alias(f"p_{c.lower()}") for i, c in enumerate(CLASSES)], F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(each, best).cast("int")).alias("direction"), best.alias("score"))


def wanted(rows: DataFrame, done: DataFrame, mode: str, ids: DataFrame | None = None, key: str = "news_id") -> DataFrame:
    """Rows to score: ``incremental`` those without a prediction, ``full`` all, ``ids`` exactly the listed ones (a missing one raises)."""
    if mode == "full":
        return rows
    if mode == "incremental":
        return rows.join(done.select(key).distinct(), key, "left_anti")
    if mode != "ids" or ids is None:
        raise ValueError(f"no such mode: {mode}")
    if not ids.join(rows.select(key), key, "left_anti").isEmpty():
        raise ValueError("an id that is to be scored has no features")
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def prediction_checks(rows: DataFrame, key: list[str], tolerance: float = 1e-5) -> DataFrame:
    """One row: predictions, repeated keys, rows whose probabilities do not add up to 1, rows without a direction."""
    total = reduce(lambda a, b: a + b, [F.col(f"p_{c.lower()}") for c in CLASSES])
    per = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.abs(total - 1) > tolerance).alias("off"), F.count_if(F.col("direction").isNull()).alias("open"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(whole("n").alias("predictions"), F.count_if(F.col("n") > 1).alias("repeated_keys"), whole("off").alias("bad_sums"), whole("open").alias("no_direction"))
