"""Gradient-boosted trees of several classes: softmax gradients, one tree for each class and round.

Features are binned once and kept as one byte each.  A level of the trees is
one Spark job: every task sums gradients by class, node, feature and bin into
arrays of a fixed size, the sums are added up by a shuffle, and a window over
the bins finds each node's best split.  The driver sees one row for each node.
Sums are whole numbers (gradients in units of 2**-20), so the trees do not
depend on how rows are dealt to tasks.

Nulls and NaN are a bin of their own, which numeric splits may send to either
side.  Categorical features are codes from 0 on; their bins are ordered by
gradient before they are cut.  Rows without a known label do not train.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut, written

#: A gradient of 1 as a whole number.
UNIT = 1 << 20
#: Bins of a feature, that of missing values included: a bin is one byte.
MOST_BINS = 255


@dataclass(frozen=True)
class Settings:
    """Rounds, shrinkage, depth of a tree, least rows of a leaf, share of features a tree sees, L1 and L2, smoothing of categories."""

    rounds: int = 500
    rate: float = 0.03
    depth: int = 5
    least_rows: int = 50
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 0.1
    smooth: float = 10.0
    least_hessian: float = 1e-3
    seed: int = 42
    #: Margins are written to the shared folder after so many rounds.
    keep: int = 25


@dataclass(frozen=True)
class Bins:
    """Names of features, the upper bounds of their bins, and which of them are categories."""

    features: list[str]
    edges: list[list[float]]
    categories: list[str]

    def of(self, rows: pd.DataFrame) -> np.ndarray:
        """One byte for each row and feature; 0 stands for a missing value."""
        return self.placed([rows[name].to_numpy(np.float64, na_value=np.nan) for name in self.features])

    def placed(self, columns: list[np.ndarray]) -> np.ndarray:
        """``of`` for the features' columns, where NaN is missing."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for i, (values, edges) in enumerate(zip(columns, self.edges, strict=True)):
            known = ~np.isnan(values)
            out[known, i] = 1 + np.searchsorted(np.asarray(edges), values[known], side="left")
        return out


@dataclass
class Tree:
    """Nodes numbered as in a heap: the feature each one asks (-1 at a leaf), which bins go left, and the value of each node."""

    feature: list[int]
    left: list[list[int]]
    value: list[float]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        goes = np.zeros((len(self.left), MOST_BINS + 1), bool)
        for node, bins in enumerate(self.left):
            goes[node, bins] = True
        return np.asarray(self.feature), goes, np.asarray(self.value)


@dataclass
class Model:
    bins: Bins
    classes: list[str]
    start: list[float]
    trees: list[list[Tree]] = field(default_factory=list)
    #: Gain summed over the splits of each feature.
    gain: dict[str, float] = field(default_factory=dict)

    def dumped(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loaded(text: str) -> Model:
        m = json.loads(text)
        return Model(Bins(**m["bins"]), m["classes"], m["start"], [[Tree(**t) for t in one] for one in m["trees"]], m["gain"])


def _nodes(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches."""
    feature, goes, _ = tree
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        asked = feature[at]
        left = goes[at, bins[rows, np.maximum(asked, 0)]]
        at = np.where(asked >= 0, 2 * at + np.where(left, 1, 2), at)
    return at


def _margins(base: np.ndarray, bins: np.ndarray, rounds: list[list[tuple]], depth: int) -> np.ndarray:
    out = base.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += tree[2][_nodes(tree, bins, depth)]
    return out


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bins_of(rows: DataFrame, features: list[str], categories: list[str] = (), most: int = 64, accuracy: int = 10_000) -> Bins:
    """Upper bounds of at most ``most`` bins of about equal counts for each feature, by one aggregate over all rows.

    A feature of categories takes a bin for each code; more than 254 codes
    raise ValueError.  What reaches the driver is bounded by features and bins.
    """
    if not 2 <= most < MOST_BINS:
        raise ValueError(f"bins are between 2 and {MOST_BINS - 1}: {most}")
    shares = [i / most for i in range(1, most)]
    number = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None))
    wanted = [F.max(number(f)).alias(f"f{i}") if f in categories else F.percentile_approx(number(f), shares, accuracy).alias(f"f{i}") for i, f in enumerate(features)]
    # a task's summaries have a fixed size and one task puts them together: as many of them as there are cores, not as the input has parts
    found = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism).agg(*wanted).first()
    edges = []
    for i, f in enumerate(features):
        got = found[f"f{i}"]
        if f in categories:
            codes = 0 if got is None else int(got) + 1
            if codes >= MOST_BINS:
                raise ValueError(f"{f} has {codes} categories; at most {MOST_BINS - 1} fit")
            edges.append([k + 0.5 for k in range(codes - 1)])
        else:
            edges.append(sorted(set(got or [])))
    return Bins(list(features), edges, [f for f in features if f in categories])


def _bytes(rows: DataFrame, bins: Bins, keys: list[str]) -> DataFrame:
    """``keys`` and ``bins_``, a byte for each feature."""
    ready = rows.select(*keys, *[F.col(f).cast("double").alias(f"f{i}_") for i, f in enumerate(bins.features)])
    width, first = len(bins.features), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = bins.placed([np.array(c.fill_null(np.nan)) for c in batch.columns[first:]]).tobytes()
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(width))
            each = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], each], names=[*batch.schema.names[:first], "bins_"])

    return ready.mapInArrow(run, ready.select(*keys).schema.add("bins_", "binary"))


def _bins_of_batch(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a batch's ``bins_``, one row for each of its rows, without an object for each."""
    n = len(column)
    if not n:
        return np.zeros((0, width), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])).reshape(n, width)


def _margins_of_batch(column: pa.Array, classes: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), classes)


def labelled_bins(rows: DataFrame, bins: Bins, label: str, classes: list[str], keys: list[str] = ()) -> DataFrame:
    """``binned`` for all rows: ``y_`` is null where the label is unknown; the rows with one train, all are scored."""
    place = F.when(F.col(label).isin(*classes), (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("int"))
    return written(_bytes(rows.withColumn("y_", place), bins, [*keys, "y_"]), "bins")


def binned(rows: DataFrame, bins: Bins, label: str, classes: list[str], keys: list[str] = ()) -> DataFrame:
    """``keys``, ``y_`` (place of the label among the classes), ``bins_``; rows with a known label, written once to the shared folder."""
    place = (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("int")
    return cut(_bytes(rows.filter(F.col(label).isin(*classes)).withColumn("y_", place), bins, [*keys, "y_"]))


def _histograms(width: int, classes: int, trees: list[list[tuple]], growing: list[tuple], asked: list[np.ndarray], level: int, depth: int) -> Callable:
    """The function of a task: sums of gradient, hessian and rows for each class, node of a level, feature and bin."""
    first, open_ = (1 << level) - 1, 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (classes, open_, width, MOST_BINS + 1)
        sums = [np.zeros(shape, np.int64) for _ in range(3)]
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _bins_of_batch(batch.column("bins_"), width)
            y = np.array(batch.column("y_"))
            p = _softmax(_margins(_margins_of_batch(batch.column("m_"), classes), bins, trees, depth))
            for c in range(classes):
                at = _nodes(growing[c], bins, level) - first
                here = at >= 0
                g = np.rint((p[here, c] - (y[here] == c)) * UNIT)
                h = np.rint(p[here, c] * (1 - p[here, c]) * (classes / (classes - 1)) * UNIT)
                for f in asked[c]:
                    place = at[here] * (MOST_BINS + 1) + bins[here, f]
                    for total, weights in zip(sums, (g, h, None), strict=True):
                        total[c, :, f, :] += np.bincount(place, weights, open_ * (MOST_BINS + 1)).astype(np.int64).reshape(open_, -1)
        found = np.nonzero(sums[2])
        places = [pa.array(x.astype(np.int32)) for x in (found[0], found[1] + first, found[2], found[3])]
        yield pa.RecordBatch.from_arrays([*places, *(pa.array(x[found]) for x in sums)], names=["c", "node", "feature", "bin", "g", "h", "n"])

    return run


def _splits(sums: DataFrame, categories: list[int], s: Settings) -> list:
    """The best split of each class and node: feature, bins that go left, sums of both sides.

    Numeric bins are cut in order with the missing ones first or last, categories in the order of gradient over hessian.
    """
    # the tasks' sums are dealt once: the sums of bins and the windows over them stay on that partitioning
    total = sums.repartition("c", "node", "feature").groupBy("c", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    category = F.col("feature").isin(categories) if categories else F.lit(False)
    ways = F.when(category, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    place = F.when(category, F.col("g") / (F.col("h") + s.smooth * UNIT)).when((F.col("bin") == 0) & (F.col("way") == 1), F.lit(1e9)).otherwise(F.col("bin").cast("double"))
    side = Window.partitionBy("c", "node", "feature", "way").orderBy("place", "bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("c", "node", "feature", "way")
    rows = total.withColumn("way", F.explode(ways)).withColumn("place", place)
    rows = rows.select("c", "node", "feature", "way", "place", *[F.sum(x).over(side).alias(f"{x}l") for x in "ghn"], *[F.sum(x).over(whole).alias(f"{x}a") for x in "ghn"], F.collect_list("bin").over(side).alias("bins"))
    for x in "ghn":
        rows = rows.withColumn(f"{x}r", F.col(f"{x}a") - F.col(f"{x}l"))
    score = lambda k: F.pow(F.greatest(F.abs(F.col(f"g{k}") / UNIT) - s.l1, F.lit(0.0)), 2) / (F.col(f"h{k}") / UNIT + s.l2)
    fits = lambda k: (F.col(f"n{k}") >= s.least_rows) & (F.col(f"h{k}") >= s.least_hessian * UNIT)
    rows = rows.filter(fits("l") & fits("r")).withColumn("gain", score("l") + score("r") - score("a")).filter("gain > 1e-12")
    order = F.struct(F.col("gain"), -F.col("feature"), -F.col("way"), -F.col("place"))
    best = F.struct("feature", "bins", "gl", "hl", "gr", "hr", "ga", "ha", "gain")
    return rows.groupBy("c", "node").agg(F.max_by(best, order).alias("b")).select("c", "node", "b.*").collect()


def fit(table: DataFrame, bins: Bins, classes: list[str], settings: Settings = Settings(), use: list[str] | None = None) -> Model:
    """Trees on a table from ``binned``; ``use`` names the features that may be asked (all by default).

    An empty table gives a model without trees whose classes are equally likely.
    """
    s, k, width = settings, len(classes), len(bins.features)
    counts = {r["y_"]: r["n"] for r in table.groupBy("y_").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    start = [float(np.log(max(counts.get(c, 0), 1e-9) / rows)) if rows else 0.0 for c in range(k)]
    model = Model(bins, list(classes), start)
    if not rows:
        return model
    allowed = np.array([i for i, f in enumerate(bins.features) if use is None or f in use])
    if not len(allowed):
        return model
    categories = [bins.features.index(f) for f in bins.categories]
    state = table.select("y_", "bins_", F.array(*map(F.lit, start)).alias("m_"))
    dice = np.random.default_rng(s.seed)
    applied: list[list[tuple]] = []
    size = (1 << (s.depth + 1)) - 1
    value = lambda g, h: float(-np.sign(g) * max(abs(g / UNIT) - s.l1, 0.0) / (h / UNIT + s.l2) * s.rate)
    for done in range(s.rounds):
        asked = [np.sort(dice.choice(allowed, max(1, round(len(allowed) * s.columns)), replace=False)) for _ in classes]
        trees = [Tree([-1] * size, [[] for _ in range(size)], [0.0] * size) for _ in classes]
        for level in range(s.depth):
            run = _histograms(width, k, applied, [t.arrays() for t in trees], asked, level, s.depth)
            found = _splits(state.mapInArrow(run, "c int, node int, feature int, bin int, g long, h long, n long"), categories, s)
            for r in found:
                tree, node = trees[r["c"]], r["node"]
                tree.feature[node], tree.left[node] = r["feature"], sorted(r["bins"])
                tree.value[2 * node + 1], tree.value[2 * node + 2] = value(r["gl"], r["hl"]), value(r["gr"], r["hr"])
                name = bins.features[r["feature"]]
                model.gain[name] = model.gain.get(name, 0.0) + r["gain"]
            if not found:
                break
        if all(t.feature[0] < 0 for t in trees):
            break
        model.trees.append(trees)
        applied.append([t.arrays() for t in trees])
        if (done + 1) % s.keep == 0 and done + 1 < s.rounds:
            state, applied = cut(_advanced(state, applied, width, s.depth)), []
    return model


def _advanced(state: DataFrame, rounds: list[list[tuple]], width: int, depth: int) -> DataFrame:
    """The table with the margins after some more rounds."""

    classes = len(rounds[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _margins(_margins_of_batch(batch.column("m_"), classes), _bins_of_batch(batch.column("bins_"), width), rounds, depth)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(classes))
            margins = pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("y_"), batch.column("bins_"), margins], names=["y_", "bins_", "m_"])

    return state.mapInArrow(run, state.schema)


def predicted(table: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys``, a probability ``p_<class>`` of each class, the likeliest class as ``direction`` (ties: the first) and its probability ``score``.

    ``table`` has the bytes ``bins_`` of ``binned``, made with the model's bins.
    """
    names, width = [f"p_{c.lower()}" for c in model.classes], len(model.bins.features)
    rounds = [[t.arrays() for t in trees] for trees in model.trees]
    depth = max((int(np.log2(len(t.feature) + 1)) - 1 for trees in model.trees for t in trees), default=0)
    start = np.asarray(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _softmax(_margins(np.tile(start, (batch.num_rows, 1)), _bins_of_batch(batch.column("bins_"), width), rounds, depth))
            each = [pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *each], names=[*batch.schema.names[:-1], *names])

    schema = table.select(*keys).schema
    for n in names:
        schema = schema.add(n, "double")
    best = F.greatest(*names)
    way: Column = F.when(F.col(names[0]) == best, model.classes[0])
    for n, c in zip(names[1:], model.classes[1:], strict=True):
        way = way.when(F.col(n) == best, c)
    return table.select(*keys, "bins_").mapInArrow(run, schema).withColumns({"direction": way, "score": best})


def scored(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``predicted`` for rows with the model's features, labelled or not."""
    return predicted(_bytes(rows, model.bins, keys), model, keys)


def save(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(model.dumped(),)], "model string").coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model.loaded(spark.read.schema("model string").json(path).first()["model"])


def importance(spark: SparkSession, model: Model) -> DataFrame:
    """feature, importance (its share of all gain) from the greatest on; features that no tree asks have 0."""
    whole = sum(model.gain.values()) or 1.0
    return spark.createDataFrame([(f, model.gain.get(f, 0.0) / whole) for f in model.bins.features], "feature string, importance double").orderBy(F.desc("importance"), "feature")
