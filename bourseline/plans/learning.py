"""Training data, folds, baselines, scores and metrics of direction models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, learning
from ..operators.lineage import written
from . import features
from .facades import BARS, MASTER, NEWS, news, quantized, table, with_views
from .registry import query
from .series import _BASE, _CUT, _NUM, forward_labels

_LABELLED = """labelled AS (SELECT b.news_id, CAST(b.published_at AS DATE) AS day, CASE WHEN n.close / b.close - 1 >= 0.0075 THEN 'POSITIVE' WHEN n.close / b.close - 1 <= -0.0075 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
 FROM base b JOIN num n ON n.security_id = b.security_id AND n.session = b.session + 1)"""
_SPLIT = "DATE '1997-01-01'"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id, day, label of every item whose next session is known."""
    days = news(spark, sf_dir).select("news_id", F.col("published_at").cast("date").alias("day"))
    return forward_labels(spark, sf_dir).filter("direction_1d IS NOT NULL").select("news_id", F.col("direction_1d").alias("label")).join(days, "news_id").select("news_id", "day", "label")


@query(with_views(f"""SELECT label, COUNT(*) FILTER (WHERE day < {_SPLIT}) AS train_rows, COUNT(*) FILTER (WHERE day >= {_SPLIT}) AS test_rows FROM labelled GROUP BY label""", BARS, NEWS, _CUT, _NUM, _BASE, _LABELLED))
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.col("day") < F.lit("1997-01-01").cast("date")
    return labelled(spark, sf_dir).groupBy("label").agg(F.count_if(train).alias("train_rows"), F.count_if(~train).alias("test_rows"))


@query(with_views(f"""SELECT modal, COUNT(*) AS test_rows, FLOOR(COUNT(*) FILTER (WHERE label = modal) * 1e4 / COUNT(*) + 0.5) / 1e4 AS accuracy FROM labelled, (SELECT label AS modal FROM labelled WHERE day < {_SPLIT}
 GROUP BY label ORDER BY COUNT(*) DESC, label LIMIT 1) m WHERE day >= {_SPLIT} GROUP BY modal""", BARS, NEWS, _CUT, _NUM, _BASE, _LABELLED))  # fmt: skip
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on later days of always predicting the earlier days' most frequent class."""
    rows = labelled(spark, sf_dir)
    train = F.col("day") < F.lit("1997-01-01").cast("date")
    modal = rows.filter(train).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("modal"))
    test = rows.filter(~train).join(F.broadcast(modal))
    return test.groupBy("modal").agg(F.count("*").alias("test_rows"), (F.floor(F.count_if(F.col("label") == F.col("modal")) * F.lit(1e4) / F.count("*") + 0.5) / 1e4).alias("accuracy"))


@query("""SELECT label, CAST(SUM(n) AS BIGINT) AS support, FLOOR(SUM(CASE WHEN label = predicted THEN n ELSE 0 END) * 1e4 / SUM(n) + 0.5) / 1e4 AS recall
 FROM (SELECT event_type AS label, CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE event_type END AS predicted, COUNT(*) AS n FROM events GROUP BY 1, 2) x GROUP BY label""")
def class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support and recall of every class, from the confusion counts."""
    predicted = F.when(F.col("user_id") % 3 == 0, "click").when(F.col("user_id") % 3 == 1, "view").otherwise(F.col("event_type"))
    return learning.class_report(learning.confusion(table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), predicted.alias("predicted")))).select("label", "support", quantized(F.col("recall")).alias("recall"))


_METRICS = """m AS (SELECT label, SUM(n) AS support, SUM(n) FILTER (WHERE label = predicted) AS hits FROM c GROUP BY 1), r AS (SELECT m.label, support, COALESCE(hits, 0) / support AS recall,
 COALESCE(COALESCE(hits, 0) / s.said, 0) AS precision FROM m LEFT JOIN (SELECT predicted, SUM(n) AS said FROM c GROUP BY 1) s ON s.predicted = m.label), f AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM r)"""
_COUNTS = """c AS (SELECT event_type AS label, CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE event_type END AS predicted, COUNT(*) AS n FROM events GROUP BY 1, 2)"""
_ROUNDED = "FLOOR(SUM(recall * support) / SUM(support) * 1e4 + 0.5) / 1e4 AS accuracy, FLOOR(AVG(recall) * 1e4 + 0.5) / 1e4 AS balanced_accuracy, FLOOR(AVG(f1) * 1e4 + 0.5) / 1e4 AS macro_f1"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.when(F.col("user_id") % 3 == 0, "click").when(F.col("user_id") % 3 == 1, "view").otherwise(F.col("event_type"))
    return learning.confusion(table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), predicted.alias("predicted")))


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*[quantized(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


@query(with_views("SELECT label, CAST(support AS BIGINT) AS support, FLOOR(recall * 1e4 + 0.5) / 1e4 AS recall, FLOOR(precision * 1e4 + 0.5) / 1e4 AS precision, FLOOR(f1 * 1e4 + 0.5) / 1e4 AS f1 FROM f", _COUNTS, _METRICS))
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, recall, precision and F1 of every class."""
    return _rounded(learning.class_report(_counts(spark, sf_dir)), "recall", "precision", "f1")


@query(with_views(f"SELECT {_ROUNDED} FROM f", _COUNTS, _METRICS))
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(learning.summary(_counts(spark, sf_dir)), "accuracy", "balanced_accuracy", "macro_f1")


@query(with_views(f"SELECT {_ROUNDED} FROM f", BARS, NEWS, _CUT, _NUM, _BASE, _LABELLED, f"c AS (SELECT label, (SELECT label FROM labelled WHERE day < {_SPLIT} GROUP BY label ORDER BY COUNT(*) DESC, label LIMIT 1) AS predicted, COUNT(*) AS n FROM labelled WHERE day >= {_SPLIT} GROUP BY 1)", _METRICS))
def majority_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three metrics of the baseline that always predicts the earlier days' most frequent class."""
    train, test = learning.chronological(labelled(spark, sf_dir), "day", "1997-01-01")
    return _rounded(learning.majority_metrics(train, test), "accuracy", "balanced_accuracy", "macro_f1")


@query("""SELECT o_orderkey AS news_id, CAST((SELECT COUNT(*) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderkey % 9 > 0 UNION SELECT '__MISSING__') d WHERE d.v < COALESCE(CASE WHEN o.o_orderkey % 9 > 0 THEN o.o_orderpriority END, '__MISSING__')) AS INT) AS code FROM orders o""")
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories as their place in the vocabulary of the whole table; missing ones have a value of their own."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("news_id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")).alias("category"))
    return learning.coded(rows, "category", learning.vocabulary(rows, "category"), "code").select("news_id", "code")


@query("""SELECT metric, FLOOR(AVG(v) * 1e4 + 0.5) / 1e4 AS mean, FLOOR(STDDEV_SAMP(v) * 1e4 + 0.5) / 1e4 AS std, FLOOR(MIN(v) * 1e4 + 0.5) / 1e4 AS least, FLOOR(MAX(v) * 1e4 + 0.5) / 1e4 AS greatest FROM (
 SELECT 'accuracy' AS metric, AVG(l_tax * 10) AS v FROM lineitem GROUP BY l_linenumber UNION ALL SELECT 'macro_f1', AVG(l_discount * 10) FROM lineitem GROUP BY l_linenumber) x GROUP BY 1""")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation, least and greatest of each metric over the folds."""
    folds = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg(F.col("l_tax") * 10).alias("accuracy"), F.avg(F.col("l_discount") * 10).alias("macro_f1"))
    return _rounded(learning.fold_summary(folds, ["accuracy", "macro_f1"]), "mean", "std", "least", "greatest")


@query("""SELECT mode, COUNT(*) AS n FROM (SELECT 'full' AS mode FROM orders UNION ALL SELECT 'incremental' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)
 UNION ALL SELECT 'ids' FROM orders WHERE o_orderkey % 100 = 0) x GROUP BY 1""")
def scoring_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each mode of scoring takes."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("news_id"))
    done = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("news_id"))
    taken = [learning.wanted(rows, done, mode, rows.filter("news_id % 100 = 0")).select(F.lit(mode).alias("mode")) for mode in ("full", "incremental", "ids")]
    return taken[0].unionByName(taken[1]).unionByName(taken[2]).groupBy("mode").agg(F.count("*").alias("n"))


@query("""SELECT CAST(SUM(n) AS BIGINT) AS predictions, COUNT(*) FILTER (WHERE n > 1) AS repeated_keys, CAST(SUM(off) AS BIGINT) AS bad_sums, CAST(SUM(open) AS BIGINT) AS no_direction FROM (
 SELECT l_orderkey, l_linenumber, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_partkey % 50 = 0) AS off, COUNT(*) FILTER (WHERE l_partkey % 30 = 0) AS open FROM lineitem GROUP BY 1, 2) x""")
def prediction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions verified: repeated keys, probabilities that do not add up, rows without a direction."""
    bad = F.col("l_partkey") % 50 == 0
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0.25).alias("p_negative"), F.lit(0.25).alias("p_neutral"), F.when(bad, 0.4).otherwise(0.5).alias("p_positive"), F.when(F.col("l_partkey") % 30 != 0, "POSITIVE").alias("direction"))
    return learning.prediction_checks(rows, ["l_orderkey", "l_linenumber"])


_FOLDS = """days AS (SELECT DISTINCT day FROM labelled), w AS (SELECT CAST(s AS DATE) AS test_start, CAST(s + INTERVAL '2' MONTH AS DATE) AS test_end FROM (SELECT UNNEST(GENERATE_SERIES(
 CAST(DATE_TRUNC('month', MIN(day)) + INTERVAL '6' MONTH AS TIMESTAMP), CAST(DATE_TRUNC('month', MAX(day)) - INTERVAL '1' MONTH AS TIMESTAMP), INTERVAL '2' MONTH)) AS s FROM days) g),
 f AS (SELECT test_start, test_end, (SELECT COUNT(*) FROM days WHERE day < test_start) AS ahead, (SELECT MAX(day) FROM days WHERE day < (SELECT MAX(day) FROM days WHERE day < test_start)) AS train_end,
 (SELECT COUNT(*) FROM days WHERE day >= test_start AND day < test_end) AS inside FROM w), k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY test_start DESC) AS back FROM f WHERE ahead > 60 AND inside > 0),
 p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY test_start) AS fold FROM k WHERE back <= 5)"""


@query(with_views("""SELECT CAST(fold AS INT) AS fold, CASE WHEN day <= train_end THEN 'train' ELSE 'test' END AS part, COUNT(*) AS n, MIN(day) AS first_day, MAX(day) AS last_day FROM labelled, p
 WHERE day <= train_end OR (day >= test_start AND day < test_end) GROUP BY 1, 2""", BARS, NEWS, _CUT, _NUM, _BASE, _LABELLED, _FOLDS))  # fmt: skip
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five expanding folds of two test months each, with rows in train and test."""
    rows = labelled(spark, sf_dir)
    return learning.tagged(rows, learning.folds(rows, "day")).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


#: Features of the event-feature row that boosting asks: all its numbers but what comes after the item, the time, and two categories as codes.
FEATURES = [*(c for c in features.NUMBERS if not c.startswith("forward_")), "publication_hour", "publication_minute", "publication_weekday", "sequence_rows"]
CATEGORIES = ["feed_category", "exchange"]
KEYS = ["news_id", "security_id", "exchange", "day"]
#: A short run of the operator's defaults: fewer rounds of larger steps.
SETTINGS = boosting.Settings(rounds=8, rate=0.2, depth=3)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event-feature row with its categories as codes and ``day``; the row is written once, before its first use."""
    asked = [*KEYS, "prediction_eligible", "direction_1d", *FEATURES, "feed_category"]
    rows = written(features.event_feature_row(spark, sf_dir).withColumn("day", F.col("cutoff_trade_date")).select(*asked), "event_rows")
    for c in CATEGORIES:
        rows = learning.coded(rows, c, learning.vocabulary(rows, c), f"{c}_code")
    return rows


def boosted_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees trained on the eligible rows of earlier days; probabilities, direction, label and day of every row."""
    rows = event_rows(spark, sf_dir)
    codes = [f"{c}_code" for c in CATEGORIES]
    names = learning.checked_features([*FEATURES, *codes])
    train = rows.filter((F.col("day") < F.lit("1997-01-01").cast("date")) & F.col("prediction_eligible"))
    bins = boosting.bins_of(train, names, codes)
    keys = [*KEYS, "prediction_eligible", "direction_1d"]
    table = boosting.labelled_bins(rows, bins, "direction_1d", list(learning.CLASSES), keys)
    train = table.filter((F.col("day") < F.lit("1997-01-01").cast("date")) & F.col("prediction_eligible") & F.col("y_").isNotNull())
    model = boosting.fit(train, bins, list(learning.CLASSES), SETTINGS)
    return boosting.predicted(table, model, keys)


@query()
def direction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities, direction and score of every event-feature row, from trees boosted on earlier days."""
    return boosted_directions(spark, sf_dir).drop("day", "prediction_eligible", "direction_1d")


@query(with_views("""SELECT COUNT(*) AS predictions, 0 AS repeated_keys, 0 AS bad_sums, 0 AS no_direction, 0 AS out_of_range, 0 AS not_likeliest, COUNT(*) FILTER (WHERE exchange = 'NSE') AS nse, COUNT(*) FILTER (WHERE exchange = 'BSE') AS bse
 FROM news n JOIN (SELECT security_id, UNNEST(CASE exchange_tag WHEN 'BOTH' THEN ['NSE', 'BSE'] WHEN 'BSE' THEN ['BSE'] ELSE ['NSE'] END) AS exchange FROM master) x ON x.security_id = n.security_id""", NEWS, MASTER))
def direction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the boosted scores: one for each row, probabilities in range that add up to 1, the likeliest class as direction."""
    rows = boosted_directions(spark, sf_dir)
    each = F.array(*[F.col(f"p_{c.lower()}") for c in learning.CLASSES])
    own = F.element_at(each, F.array_position(F.array(*map(F.lit, learning.CLASSES)), F.col("direction")).cast("int"))
    rows = rows.withColumns({"range_": F.exists(each, lambda p: (p < 0) | (p > 1)), "least_": own < F.array_max(each)})
    counts = rows.agg(F.count_if("range_").alias("out_of_range"), F.count_if("least_").alias("not_likeliest"), F.count_if(F.col("exchange") == "NSE").alias("nse"), F.count_if(F.col("exchange") == "BSE").alias("bse"))
    return learning.prediction_checks(rows, ["news_id", "security_id", "exchange"]).join(F.broadcast(counts))
