"""Connected components by contraction, all in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` for every end of an edge (columns ``u, v``): the least vertex of its component.

    Each round hooks every vertex to its least neighbour and contracts the
    edges, so the number of rounds is logarithmic, and each round's edges are
    written to the shared folder.  No round collects more than a count.
    """
    left = stored(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        again = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = stored(parent.join(again, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("u").alias("v"), F.col("p").alias("label"))
        else:
            labels = stored(labels.join(parent.select(F.col("u").alias("label"), "p"), "label", "left").select("v", F.coalesce("p", "label").alias("label")), "labels")
        last = left
        ends = left.join(parent.select("u", F.col("p").alias("a")), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        left = stored(ends.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        discard(last)
    return left.select("v", F.col("u").alias("label")) if labels is None else labels
