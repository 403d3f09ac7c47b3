"""A stored index of vectors in k-means cells, searched by probing the cells next to a query.

``build`` writes the vectors once, partitioned by cell; ``search`` reads only
the probed cells.  Centres come from a bounded sample, every vector is
indexed.  How many cells to probe for a stated recall is measured
(``probes_for``); probing all cells is exact.  Vectors without a direction
(null, empty, a null or no finite length in it, length 0) have no cosine: they
are not indexed and find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Vectors that are compared at a time: a task holds two blocks of so many, one of the index and one of queries.
BLOCK = 4096
#: Cosines of vectors and centres that a task holds at a time.
PIECE = 1 << 18
#: Most cells: the centres, which every task gets, are bounded by them.
MOST_CELLS = 4096


@dataclass(frozen=True)
class Index:
    """The stored vectors (id, e of length 1, block, cell) and the centres of the cells."""

    vectors: DataFrame
    centres: np.ndarray


def _unit(rows: DataFrame) -> DataFrame:
    """vec_id and e scaled to length 1."""
    e = F.col("e").cast("array<double>")
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("vec_id", e.alias("e"), length.alias("l_")).filter((F.col("l_") > 0) & (F.col("l_") < float("inf"))).select("vec_id", F.transform("e", lambda x: x / F.col("l_")).alias("e"))


def _cells(part: pd.DataFrame, centres: np.ndarray, probes: int) -> Iterator[pd.DataFrame]:
    """The rows of ``_placed`` of some vectors, in pieces that neither the cells nor the probes make larger."""
    step = max(1, PIECE // len(centres))
    for i in range(0, len(part), step):
        own = part.iloc[i : i + step]
        near = np.stack(own["e"]) @ centres.T
        order = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
        n = order.shape[1]
        yield pd.DataFrame({"vec_id": np.repeat(own["vec_id"].to_numpy(), n), "e": own["e"].repeat(n).to_numpy(), "cell": order.ravel().astype("int32"), "rank": np.tile(np.arange(1, n + 1, dtype="int32"), len(own))})


def _placed(units: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Every vector with the ``probes`` cells of greatest cosine (cell, rank from 1; ties: the lower cell)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from _cells(part, centres, probes)

    return units.mapInPandas(run, "vec_id long, e array<double>, cell int, rank int")


def _blocked(rows: DataFrame, name: str) -> DataFrame:
    """Rows dealt within their cell into as many blocks as its size asks for, so that a crowded cell is many groups."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{name}s"))
    return rows.join(F.broadcast(sizes), "cell").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(f"{name}s")).cast("int"))


def build(rows: DataFrame, path: str, cells: int | None = None, sample: int = 50_000, seed: int = 1) -> Index:
    """Index all vectors (vec_id, e) under a shared path; an empty table has no cells.

    ``cells`` is the root of the count by default, ``MOST_CELLS`` at most; the
    centres are fitted on the ``sample`` vectors of least hash.
    """
    spark = rows.sparkSession
    units = _unit(rows)
    n = units.count()
    cells = min(cells or round(math.sqrt(n)), MOST_CELLS, n)
    taken = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(array_to_vector("e").alias("features"))
    centres = np.zeros((0, 0))
    if cells > 1:
        centres = np.stack(KMeans(k=cells, seed=seed, distanceMeasure="cosine").fit(taken).clusterCenters())
    elif cells == 1:
        centres = np.ones((1, len(units.first()["e"])))
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    placed = _blocked(cut(_placed(units, centres, 1).drop("rank")), "block") if cells else units.limit(0).selectExpr("vec_id", "e", "0 AS cell", "0 AS block")
    placed.select("vec_id", "e", "block", "cell").repartition("cell", "block").write.partitionBy("cell").parquet(f"{path}/vectors")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    centres = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()
    return Index(spark.read.schema("vec_id long, e array<double>, block int, cell int").parquet(f"{path}/vectors"), np.array([r["centre"] for r in centres]))


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """vec_id, neighbour, score, cell: the k greatest cosines of each query (vec_id, e) in the ``probes`` cells next to it, itself left out.

    Ties in four digits go to the lower id, as in an exact search.  A block of
    queries meets a block of vectors as one product of matrices; what leaves
    it is k rows a query.
    """
    spark = queries.sparkSession
    out = "vec_id long, neighbour long, score double, cell int"
    if not len(index.centres):
        return spark.createDataFrame([], out)
    asked = _blocked(_placed(_unit(queries), index.centres, probes).drop("rank"), "part")
    parts = asked.select("cell", "parts").distinct()
    # the cells are partitions of the stored table: only the probed ones are read
    stored = index.vectors.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    blocks = index.vectors.groupBy("cell").agg(F.max("block").alias("last"))
    asked = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).select("vec_id", "e", "cell", "block", "part")

    def met(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"vec_id": [], "neighbour": [], "score": [], "cell": []})
        ids = r["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], np.stack(r["e"])[by_id]
        found = []
        for i in range(0, len(q), 256):
            own = q["vec_id"].to_numpy()[i : i + 256]
            score = np.stack(q["e"][i : i + 256]) @ vectors.T
            grid = np.where(own[:, None] == ids[None, :], -np.inf, np.floor(score * 1e4 + 0.5))
            best = np.argsort(-grid, axis=1, kind="stable")[:, :k]
            rows = np.arange(len(own))[:, None]
            kept = np.isfinite(grid[rows, best])
            found.append(pd.DataFrame({"vec_id": np.broadcast_to(own[:, None], best.shape)[kept], "neighbour": ids[best][kept], "score": score[rows, best][kept]}))
        return pd.concat(found).assign(cell=r["cell"].iloc[0])

    keys = ["cell", "block", "part"]
    near = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(met, out)
    best = Window.partitionBy("vec_id").orderBy(F.desc(F.floor(F.col("score") * 1e4 + 0.5)), "neighbour")
    return near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def probes_for(index: Index, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The fewest cells to probe so that these queries (a bounded sample) find the share ``recall`` of their exact neighbours.

    One exact search tells in which cell each neighbour lies; the wanted share of those cells' ranks is the answer.
    """
    cells = len(index.centres)
    if not cells:
        return 0
    exact = search(index, queries, k, cells).select("vec_id", "cell")
    ranks = _placed(_unit(queries), index.centres, cells).select("vec_id", "cell", "rank")
    counts = exact.join(ranks, ["vec_id", "cell"]).groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").collect()
    whole, found = sum(r["n"] for r in counts), 0
    for r in counts:
        found += r["n"]
        if found >= recall * whole:
            return r["rank"]
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact neighbours, those that were found, and their share."""
    wanted = exact.select("vec_id", "neighbour").distinct()
    hit = found.select("vec_id", "neighbour", F.lit(1).alias("hit_")).distinct()
    return wanted.join(hit, ["vec_id", "neighbour"], "left").agg(F.count("*").alias("wanted"), F.count("hit_").alias("found"), F.try_divide(F.count("hit_"), F.count("*")).alias("recall"))
