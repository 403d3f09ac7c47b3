"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to ``longest`` letters,
words padded with a space) by falling count.  A document is compared to each
language's profile by the out-of-place distance: the sum, over the document's
own most frequent n-grams, of the difference of the two ranks, or the greatest
distance where the profile lacks the n-gram.  The nearest profile wins; equal
distances go to the language that sorts first.

Profiles are learned from at most ``sample_docs`` labelled documents of each
language (those whose doc_id has the least hash), the documented bound of the
fit.  Every whole text is then compared.

Null text, empty text and text without a letter give ``und`` with score 0, as
does a table without a single labelled row to learn from.  Repeated rows are
judged one by one.  A null doc_id is neither held out nor learned from.  Input
columns named like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_names, texts_of

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    points = [i for i in range(0x110000) if chr(i).isalpha()]
    table[points] = points
    return table


def ngram_counts(text: str, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers (21 bits a letter) and their counts."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    space = points == 32
    keep = ~(space & np.concatenate([[False], space[:-1]]))
    points, space = points[keep], space[keep]
    grams = []
    key = points
    inner = np.zeros(len(points), bool)  # a space inside the n-gram
    for n in range(1, longest + 1):
        if n > 1:
            key = key[:-1] << np.uint64(21) | points[n - 1 :]
            inner = inner[:-1] | (space[n - 2 : n - 2 + len(key)] if n > 2 else False)
        grams.append(key[~inner & ~(space[: len(key)] & (n == 1))])
    return np.unique(np.concatenate(grams), return_counts=True)


def _top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in the order of their rank."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        keys, counts = keys[near], counts[near]
    return keys[np.lexsort((keys, -counts))[:size]]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_rows(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = total.setdefault(lang, {})
                keys, counts = ngram_counts(text, longest)
                for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
                    own[k] = own.get(k, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])

    return run


def least_of_each(rows: DataFrame, number: int, salts: int = 64) -> DataFrame:
    """The ``number`` rows of least (order, doc_id) of each language, by way of those of each of its ``salts`` parts, so that no task holds a language."""
    rank = F.row_number()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(salts)))
    rows = rows.withColumn("rank", rank.over(Window.partitionBy("lang", "salt").orderBy("order", "doc_id"))).filter(F.col("rank") <= number)
    return rows.withColumn("rank", rank.over(Window.partitionBy("lang").orderBy("order", "doc_id"))).filter(F.col("rank") <= number)


def learn_profiles(docs: DataFrame, size: int = 400, longest: int = 3, sample_docs: int = 1500) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language, from a bounded sample of labelled documents."""
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = least_of_each(labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("order")), sample_docs).select("doc_id").distinct()
    sample = texts_of(labelled.select("doc_id", "lang", "text"), chosen)
    counts = sample.mapInArrow(_count_rows(longest), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "rank").select("lang", "gram").toLocalIterator():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Judge:
    """Compares texts to profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int, longest: int):
        self.langs = sorted(profiles)
        self.size, self.longest = size, longest
        self.keys = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.far = max([len(p) for p in profiles.values()], default=0)
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        top = _top(*ngram_counts(text, self.longest), self.size)
        if not len(top):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, top)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == top, at, len(self.keys))
        ranks = self.ranks[at]
        place = np.arange(len(top))[:, None]
        apart = np.where(ranks < 0, self.far, np.minimum(np.abs(ranks - place), self.far)).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.far * len(top)))


def _judge_rows(profiles: dict[str, list[int]], size: int, longest: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, size, longest).judge
        for batch in batches:
            found = [judge(x) for x in batch.column("text").to_pylist()]
            names = [n for n in batch.schema.names if n not in ("lang_pred", "score") and (keep_text or n != "text")]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = 300, longest: int = 3, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text if ``keep_text`` is off) with ``lang_pred`` and ``score`` (1: the profile's own ranks, 0: nothing shared)."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    plain = plain_names([f.name for f in kept])
    stay = [(f, p) for f, p in zip(kept, plain, strict=True) if keep_text or f.name != "text"]
    out = T.StructType([T.StructField(p, f.dataType) for f, p in stay]).add("lang_pred", "string").add("score", "double")
    judged = docs.select(*[F.col(f"`{f.name}`").alias(p) for f, p in zip(kept, plain, strict=True)]).mapInArrow(_judge_rows(profiles, size, longest, keep_text), out)
    return judged.toDF(*[f.name for f, _ in stay], "lang_pred", "score")
