"""Near-duplicate documents by Order MinHash and banded alignment.

A document's words (lower case, split at white space) give k-mers of five
words, each labelled with its occurrence number.  For each of ``slots`` hash
functions the ``kept`` smallest labelled k-mers are taken and put in their text
order; the hash of that sequence is one signature.  Documents that share a
signature, and whose lengths allow the similarity, are candidates.  A candidate
pair is a link if the edit similarity of its words reaches ``similarity``: an
alignment banded to the edits that this allows decides.  Classes are the
connected components of the links.

Equal texts are one class from the start and only the least doc_id stands for
them.  First, components are merged: in every signature's group one member of
the largest component is compared to one member of each other component, over
a share of the signatures and then over all.  Groups that are one component are done.  In the
others leaders from all components but the largest are compared to all members outside
their component, then leave the group, until every candidate pair is verified
or connected, so comparisons grow with the members and the components and not
with the square of a group of copies.  A group of more than ``crowd`` members
(a passage that otherwise different texts share) is parted by its members'
rarest words first: a text of n words has one more of them than the edits it
allows, counted with repetitions, so texts as similar as asked share one of
them at least, and no candidate pair that could be a link is lost.

Null text is empty; empty texts are one class.  A text of fewer than five
words is one k-mer.  A null doc_id forms no class: its row has class_id null.
Repeated rows get the same class_id each.  An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import edits_within
from .common import discard, stored, text_or_empty, texts_of
from .graph import components

WORDS = 5
SIMILARITY = 0.8
#: Most words whose numbers set the order of rare words in crowded groups; any order finds the same links.
COMMON = 65_536

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for reuse up to ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def kmers(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of runs of ``size`` words; of the whole text if it is shorter."""
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, len(hashes[:size]), np.uint64)
    for j in range(min(size, len(hashes))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(out)


def labelled(keys: np.ndarray) -> np.ndarray:
    """K-mers (or words) made distinct by their occurrence number; a first occurrence is the same in every text."""
    order = np.argsort(keys, kind="stable")
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    if not same.any():
        return mixed(keys)
    at = np.arange(len(keys))
    number = np.empty(len(keys), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return mixed(keys + number * np.uint64(0xD6E8FEB86659FD93))


def signatures(keys: np.ndarray, slots: int, kept: int) -> np.ndarray:
    """One signature for each slot: of the ``kept`` least k-mers by the slot's order, as they stand in the text."""
    out = np.empty(slots, np.uint64)
    for first in range(0, slots, step := max(1, 400_000 // len(keys))):
        salts = mixed(np.arange(first + 1, min(slots, first + step) + 1, dtype=np.uint64))
        ranks = keys[None, :] * (salts | np.uint64(1))[:, None]
        rows = np.arange(len(salts))
        places = np.empty((len(salts), min(kept, len(keys))), np.int64)
        for j in range(places.shape[1]):
            places[:, j] = at = ranks.argmin(axis=1)
            ranks[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at = np.sort(places, axis=1)
        h = salts
        for j in range(at.shape[1]):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + keys[at[:, j]])
        out[first : first + len(h)] = h
    return out


def _sketch(slots: int, kept: int):
    """The number of words and the signatures of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            found, sizes = [np.empty(0, np.uint64)], []
            for text in batch.column("text").to_pylist():
                own = words.of(text.lower().split())
                sizes.append(len(own))
                found.append(signatures(labelled(kmers(own)), slots, kept))
            ends = np.cumsum([len(x) for x in found]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("a"), batch.column("b"), pa.array(sizes, pa.int64()), lists], names=["doc_id", "a", "b", "words", "sigs"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, numbered by their occurrence, and in how many texts of a batch each stands."""
    words = WordHashes()
    for batch in batches:
        own = [labelled(words.of(text.lower().split())) for text in batch.column("text").to_pylist()]
        found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *own]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def rarest(keys: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """One more of a text's numbered words than the edits it allows, those first that come last in ``common`` or not at all.

    Two texts of at most n words that e edits part share n - e numbered words,
    so those left out of one of them cannot be all they share.  A text without
    words has the word 0.
    """
    if not len(keys):
        return np.zeros(1, np.uint64)
    rank = np.zeros(len(keys), np.int64)
    if len(common):
        order = np.argsort(common)
        at = order[np.minimum(np.searchsorted(common, keys, sorter=order), len(common) - 1)]
        rank = np.where(common[at] == keys, len(common) - at, 0)
    return keys[np.lexsort((keys, rank))[: most_edits(len(keys), similarity) + 1]]


def _rare(common: np.ndarray, similarity: float):
    """The rarest words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            own = [rarest(labelled(words.of(text.lower().split())), common, similarity) for text in batch.column("text").to_pylist()]
            ids = np.repeat(np.array(batch.column("doc_id"), np.int64), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))], names=["id", "word"])

    return run


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two texts' words reaches ``similarity``."""
    x, y = a.lower().split(), b.lower().split()
    return edits_within(x, y, most_edits(max(len(x), len(y)), similarity)) is not None


def most_edits(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            texts = zip(batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist(), strict=True)
            good = [i for i, (a, b) in enumerate(texts) if similar(a, b, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], names=["u", "v"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) that are near duplicates, as a stored table."""
    ids = stored(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "ids")
    own = stored(texts_of(texts, ids), "texts")
    sides = pairs.join(own.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u").join(own.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    found = stored(sides.select("u", "v", "text_u", "text_v").mapInArrow(_verify(similarity), "u long, v long"), "links")
    discard(ids, own)
    return found


class _Links:
    """Verified links so far, as the component of every document that has one."""

    def __init__(self, texts: DataFrame, similarity: float):
        self.texts, self.similarity = texts, similarity
        self.done: DataFrame | None = None
        self.labels = components(texts.sparkSession.createDataFrame([], "u long, v long"))

    def entries(self, sketch: DataFrame, share: int = 1) -> DataFrame:
        """sig, id, words, label of one signature in ``share``; the component is looked up once for each document."""
        named = sketch.join(self.labels.withColumnRenamed("v", "doc_id"), "doc_id", "left")
        return named.select(F.explode(F.filter("sigs", lambda s: F.pmod(s, F.lit(share)) == 0)).alias("sig"), F.col("doc_id").alias("id"), "words", F.coalesce("label", "doc_id").alias("label"))

    def parts(self, entries: DataFrame, salt: int) -> DataFrame:
        """One member of each component in each group of more than one component, and the component's size there."""
        each = entries.groupBy("sig", "label").agg(F.min_by(F.struct("id", "words"), F.struct(F.xxhash64("id", F.lit(salt)), "id")).alias("one"), F.count("*").alias("n"))
        shared = each.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig")
        return each.join(shared, "sig", "left_semi").select("sig", "label", "one.id", "one.words", "n")

    def link(self, entries: DataFrame, chosen: DataFrame) -> bool:
        """Verify the members against the leaders of their group in other components; whether any pair was new."""
        longer = F.greatest("words", "lead_words")
        fits = longer - F.least("words", "lead_words") <= F.floor((1 - self.similarity) * longer + 1e-9)
        pairs = entries.join(chosen, "sig").filter("label <> lead_label").filter(fits).select(F.least("id", "lead").alias("u"), F.greatest("id", "lead").alias("v")).distinct()
        pairs = stored(pairs if self.done is None else pairs.join(self.done, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return False
        self.done = pairs if self.done is None else self.done.unionByName(pairs)
        found = _links(pairs, self.texts, self.similarity)
        self.labels = components(self.labels.select(F.col("label").alias("u"), "v").unionByName(found))
        return True

    def merge(self, sketch: DataFrame, share: int, salt: int) -> None:
        """Compare one member of each group's largest component to one member of each of its other components."""
        each = stored(self.parts(self.entries(sketch, share), salt), "parts")
        lead = each.groupBy("sig").agg(F.max_by(F.struct("id", "words", "label"), F.struct("n", F.xxhash64("id", F.lit(salt)), "id")).alias("lead"))
        self.link(each, lead.select("sig", F.col("lead.id").alias("lead"), F.col("lead.words").alias("lead_words"), F.col("lead.label").alias("lead_label")))
        discard(each)

    def lead(self, entries: DataFrame, leaders: int) -> DataFrame:
        """Compare leaders of each group, up to 16 times ``leaders`` from all components but the largest, to all members outside their component; the entries that stay open."""
        one = F.min_by(F.struct("id", "words"), F.struct(F.xxhash64("id"), "id")).alias("one")
        each = stored(entries.groupBy("sig", "label", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(leaders)).alias("part")).agg(one, F.count("*").alias("n")), "parts")
        sizes = each.groupBy("sig", "label").agg(F.sum("n").alias("size"))
        largest = sizes.groupBy("sig").agg(F.max_by("label", F.struct("size", "label")).alias("largest"))
        small = each.select("sig", "label", "one").join(sizes, ["sig", "label"]).join(largest, "sig").filter("label <> largest")
        chosen = small.groupBy("sig", F.pmod(F.xxhash64("one.id"), F.lit(16 * leaders)).alias("part")).agg(F.min_by(F.struct("one", "label"), F.struct("size", "one.id")).alias("lead"))
        chosen = stored(chosen.select("sig", F.col("lead.one.id").alias("lead"), F.col("lead.one.words").alias("lead_words"), F.col("lead.label").alias("lead_label")), "leaders")
        self.link(entries, chosen)
        left = entries.drop("label").join(chosen.select("sig", F.col("lead").alias("id")), ["sig", "id"], "left_anti")
        left = self.open(left)
        discard(chosen, each)
        return left

    def open(self, entries: DataFrame) -> DataFrame:
        """The entries (sig, id, words) of groups of more than one component, with their component as of now."""
        named = entries.join(self.labels.withColumnRenamed("v", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        parted = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("sig")
        return stored(named.join(parted, "sig", "left_semi").select("sig", "id", "words", "label"), "open")

    def settle(self, entries: DataFrame) -> None:
        """Compare leaders until every pair of a group is verified or connected."""
        leaders = 1
        while not entries.isEmpty():
            last, entries = entries, self.lead(entries, leaders)
            discard(last)
            leaders *= 4

    def by_rare_words(self, entries: DataFrame) -> DataFrame:
        """The entries of crowded groups, dealt again by the rarest words of their texts that several components share."""
        ids = stored(entries.select(F.col("id").alias("doc_id")).distinct(), "ids")
        texts = stored(texts_of(self.texts, ids).select("doc_id", "text"), "texts")
        counts = texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
        common = np.array([r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()], np.int64).view(np.uint64)
        rare = stored(texts.mapInArrow(_rare(common, self.similarity), "id long, word long").distinct().join(entries.select("id", "label").distinct(), "id"), "rare")
        many = rare.groupBy("word").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("word")
        dealt = entries.drop("label").join(rare.join(many, "word", "left_semi").select("id", "word"), "id")
        found = self.open(dealt.select(F.xxhash64("sig", "word").alias("sig"), "id", "words"))
        discard(ids, texts, rare)
        return found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, slots: int = 48, kept: int = 2, crowd: int = 64) -> DataFrame:
    """doc_id, class_id, copies of every document: the least doc_id of its class, and its exact copies with itself."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    sketch = stored(keyed.mapInArrow(_sketch(slots, kept), "doc_id long, a long, b long, words long, sigs array<long>"), "sketch")
    exact = stored(sketch.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "exact")
    # a doc_id that stands for two texts is one vertex; its rows' texts are all compared
    each = sketch.join(exact, ["a", "b"]).filter("doc_id = rep").select("doc_id", "words", F.explode("sigs").alias("sig"))
    # a signature of one document alone meets nothing
    group = Window.partitionBy("sig")
    met = each.select("*", F.min("doc_id").over(group).alias("x"), F.max("doc_id").over(group).alias("y")).filter("x <> y")
    last, sketch = sketch, stored(met.groupBy("doc_id", "words").agg(F.collect_set("sig").alias("sigs")), "sketch")
    discard(last)
    found = _Links(keyed, similarity)
    # a share of the signatures connects most of a group of copies; the others then see it as one component
    for share, salt in ((6, 0), (6, 1), (1, 2), (1, 3)):
        found.merge(sketch, share, salt)
    rest = found.open(found.entries(sketch).drop("label"))
    sizes = stored(rest.groupBy("sig").agg(F.count("*").alias("n")), "sizes")
    crowded = stored(rest.join(sizes.filter(F.col("n") > crowd).select("sig"), "sig", "left_semi"), "crowded")
    small = stored(rest.join(sizes.filter(F.col("n") <= crowd).select("sig"), "sig", "left_semi"), "small")
    discard(sketch, rest, sizes)
    found.settle(small)
    crowded = found.open(crowded.drop("label"))
    if not crowded.isEmpty():
        found.settle(found.by_rare_words(crowded))
    label = found.labels.select(F.col("v").alias("rep"), "label")
    classes = exact.join(label, "rep", "left").select("a", "b", F.coalesce("label", "rep").alias("class_id"), "copies")
    ids = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    named = ids.filter("doc_id IS NOT NULL").join(classes, ["a", "b"]).select("doc_id", "class_id", "copies")
    lone = ids.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return named.unionByName(lone)
