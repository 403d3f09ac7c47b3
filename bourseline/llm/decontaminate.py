"""Benchmark decontamination by latent semantic retrieval and word alignment.

1. Documents become word ids (a hash of each lower-case word), stored once.
2. Passages of ``PASSAGE`` words make a TF-IDF matrix over hashed terms.  Its
   leading right singular vectors come from a distributed randomised SVD: each
   task multiplies its own rows by a random matrix and back, the parts are
   summed by blocks of terms, and an r x r Gram matrix of the projected rows
   gives the rotation and the singular values.
3. Every document is searched with windows of 16, 32 and 64 words: the whitened
   latent vectors of its windows against those of the benchmark items, and every
   run of ``RUN`` words against those of the items.
4. Candidates are verified on the words: the longest common subsequence of item
   and surrounding words, and the share of the item's rarest words (its answer)
   found there.  Verbatim: ``verbatim`` of the item's words in order and half of
   the answer.  Paraphrase: ``loose`` of the words and ``answer`` of the answer.

Statistics, vectors and search cover all words of all documents.  Sizes on the driver depend on the number
of terms and vectors alone.  The benchmark is the
stated query set, taken in blocks of ``block_items``.

Null text or a text without a word matches nothing; an item without a word is
ignored.  Items under eight words must stand in a document word by word.  Equal
items are reported each.  Repeated rows of a document give one row for each
item.  An empty documents or benchmark table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .near_dup import mixed

TERMS = 1 << 14
PASSAGE = 64
STEP = 8
WINDOWS = (16, 32, 64)
RUN = 4  # words in a row that a document and an item share are reason enough to verify
_BLOCK = 2048
SKETCH_WORDS = 20_000  # words that are multiplied at a time: their rows fit a processor's cache
_SLICE = 32_768  # windows that are compared to the items at a time
#: Bytes of lower-case UTF-8 that part words: all of ASCII but letters and digits.
_APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_MATCHES = "doc_id long, item_id long, similarity double, overlap double, answer double"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF
        if len(self) < 400_000:
            self[word] = h
        return h


def word_ids(text: str | None, ids: dict[bytes, int]) -> np.ndarray:
    """Ids of a text's words: lower-case runs of ASCII letters and digits and of all other characters."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_APART).split()
    return np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))


def _to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _Ids()
    for batch in batches:
        found = [word_ids(x, ids).tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "ids"])


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id and the word ids of each document, stored in the shared folder."""
    return stored(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_to_ids, "doc_id long, ids binary"), "ids")


def _terms(blob: bytes) -> np.ndarray:
    return (np.frombuffer(blob, "<u4") & np.uint32(TERMS - 1)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], words: int = 150_000) -> Iterator[list[tuple[int, bytes]]]:
    """Documents in groups of about so many words; a longer document is a group of its own."""
    held, size = [], 0
    for batch in batches:
        for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            held.append((doc, blob))
            size += len(blob) // 4
            if size >= words:
                yield held
                held, size = [], 0
    if held:
        yield held


def _passages(chunk: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a chunk's words and the start of each passage; a passage never crosses documents."""
    sizes = [len(b) // 4 for _, b in chunk]
    first = np.concatenate([[0], np.cumsum(sizes)])
    starts = [np.arange(a, a + n, PASSAGE) for a, n in zip(first[:-1], sizes, strict=True) if n]
    return _terms(b"".join(b for _, b in chunk)), np.concatenate(starts) if starts else np.empty(0, np.int64)


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    n = TERMS // _BLOCK
    parts = [total[i * _BLOCK : (i + 1) * _BLOCK].tobytes() for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(parts, pa.binary())], names=["block", "data"])


def _summed(parts: DataFrame, kind: str, salts: int = 4) -> np.ndarray:
    """Sum of the tasks' parts, block by block, in two steps so that no task reads every part."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, kind).astype(kind) for x in rows["data"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "data": [total.tobytes()]})

    salted = parts.withColumn("salt", (F.rand(1) * salts).cast("int"))
    once = salted.groupBy("block", "salt").applyInPandas(lambda rows: add(rows[["block", "data"]]), "block long, data binary")
    rows = once.groupBy("block").applyInPandas(add, "block long, data binary").orderBy("block").collect()
    return np.concatenate([np.frombuffer(r["data"], kind) for r in rows]) if rows else np.empty(0, kind)


def term_weights(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Smoothed IDF of every hashed term over all passages, and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TERMS, np.int64)
        n = 0
        for chunk in _chunks(batches):
            terms, starts = _passages(chunk)
            if len(starts):
                at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
                pairs = np.sort((at * TERMS + terms).astype(np.int32 if len(starts) * TERMS < 1 << 31 else np.int64))
                new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
                df += np.bincount(pairs[new] & (TERMS - 1), minlength=TERMS)
                n += len(starts)
        if n:
            yield _blocks(df)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([np.array([n]).tobytes()], pa.binary())], names=["block", "data"])

    total = _summed(ids.mapInArrow(count, "block long, data binary"), "<i8")
    if not len(total):
        return np.zeros(TERMS), 0
    n = int(total[0])
    return np.log((1 + n) / (1 + total[1:].astype(float))) + 1, n


def passages_with(ids: DataFrame, words: np.ndarray) -> np.ndarray:
    """In how many passages each of the words (sorted ids) stands, exactly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for chunk in _chunks(batches):
            starts = _passages(chunk)[1]
            own = np.frombuffer(b"".join(b for _, b in chunk), "<u4")
            at = np.searchsorted(words, own)
            at[at == len(words)] = 0
            hit = np.flatnonzero(words[at] == own)
            passage = np.searchsorted(starts, hit, side="right")
            total += np.bincount(np.unique(passage * len(words) + at[hit]) % len(words), minlength=len(words))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["at", "n"])

    out = np.zeros(len(words), np.int64)
    for row in ids.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["at"]] = row["n"]
    return out


def latent_basis(ids: DataFrame, idf: np.ndarray, rank: int = 44, extra: int = 8, common: int = 12, seed: int = 7) -> np.ndarray:
    """TERMS x rank matrix that takes TF-IDF rows to whitened latent coordinates.

    The ``common`` strongest directions tell the language and its frequent words
    and are left out.  It is fitted on the passages of all documents.
    """
    width = common + rank + extra
    omega = np.random.default_rng(seed).standard_normal((TERMS, width)).astype(np.float32)

    def weighted(matrix: np.ndarray) -> np.ndarray:
        return (matrix * idf[:, None]).astype(np.float32)

    def rows_of(chunk: list[tuple[int, bytes]], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, each word's passage, and the passages' rows (of unit length before the product) times the matrix."""
        terms, starts = _passages(chunk)
        if not len(starts):
            return terms, terms, np.empty((0, width), np.float32)
        at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
        length = np.sqrt(np.bincount(at, idf[terms] ** 2)).astype(np.float32)
        return terms, at, np.add.reduceat(matrix[terms], starts, axis=0) / length[:, None]

    first = weighted(omega)

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, width), np.float32)
        for chunk in _chunks(batches, SKETCH_WORDS):
            terms, at, y = rows_of(chunk, first)
            if len(y):
                order = np.argsort(terms.astype(np.uint16), kind="stable")  # TERMS fit 16 bits
                own = terms[order]
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[begin]] += np.add.reduceat(y[at[order]], begin, axis=0)
        yield _blocks(total)

    sketch = _summed(ids.mapInArrow(there_and_back, "block long, data binary"), "<f4").reshape(-1, width)
    if not len(sketch):
        return np.zeros((TERMS, rank), np.float32)
    q, _ = np.linalg.qr(sketch.astype(np.float64) * idf[:, None])
    second = weighted(q)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for chunk in _chunks(batches, SKETCH_WORDS):
            y = rows_of(chunk, second)[2].astype(np.float64)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "data"])

    values, vectors = np.linalg.eigh(_summed(ids.mapInArrow(gram, "block long, data binary"), "<f8").reshape(width, width))
    order = np.argsort(values)[::-1][common : common + rank]
    strong = values[order] > 1e-9 * values.max()
    scale = np.where(strong, 1 / np.sqrt(np.where(strong, values[order], 1)), 0)
    return weighted(q @ vectors[:, order] * scale)


def longest_common(bits: dict[int, int], length: int, words: list[int]) -> int:
    """Longest common subsequence with an item given as a bit mask for each of its words."""
    full = (1 << length) - 1
    row = full
    for w in words:
        m = bits.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


def _runs(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of ``RUN`` words."""
    out = np.zeros(max(0, len(words) - RUN + 1), np.uint64)
    for j in range(RUN):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)].astype(np.uint64))
    return out


class Items:
    """A block of benchmark items, ready for the search."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], basis: np.ndarray, known: np.ndarray, frequency: np.ndarray):
        self.ids = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        vectors = np.array([basis[(w & np.uint32(TERMS - 1)).astype(np.int64)].sum(axis=0) for w in self.words], np.float32).reshape(len(rows), basis.shape[1])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        lengths = np.array([len(w) for w in self.words])
        self.window = np.array([min(range(len(WINDOWS)), key=lambda k: abs(np.log(WINDOWS[k] / n))) for n in lengths])
        self.bits, self.answers = [], []
        for w in self.words:
            bits: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                bits[x] = bits.get(x, 0) | 1 << i
            self.bits.append(bits)
            own = np.unique(w)
            rare = own[np.lexsort((own, frequency[np.searchsorted(known, own)]))]
            self.answers.append(set(rare[: max(3, len(own) // 4)].tolist()))
        pairs = np.array([(w, j) for j, a in enumerate(self.answers) for w in a], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.rare, self.rare_first = np.unique(pairs[:, 0], return_index=True)
        self.rare_count = np.diff(np.append(self.rare_first, len(pairs)))
        self.rare_item = pairs[:, 1]
        self.needed = np.array([-(-len(a) // 2) for a in self.answers])

        runs = [(h, j, i) for j, w in enumerate(self.words) if len(w) >= 8 for i, h in enumerate(_runs(w).tolist())]
        self.run, self.run_item, self.run_place = (np.array([x[i] for x in sorted(runs)], t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        self.run, self.run_first = np.unique(self.run, return_index=True)
        self.run_count = np.diff(np.append(self.run_first, len(runs)))

    def anchored(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """Document, item and the place where the item would begin, wherever both share a run of ``RUN`` words."""
        own = _runs(words)
        if not len(self.run) or not len(own):
            return []
        at = np.searchsorted(self.run, own)
        at[at == len(self.run)] = 0
        hit = np.flatnonzero(self.run[at] == own)
        doc = np.searchsorted(first, hit, side="right") - 1
        hit, doc = hit[hit + RUN <= first[doc + 1]], doc[hit + RUN <= first[doc + 1]]
        n = self.run_count[at[hit]]
        entry = np.repeat(self.run_first[at[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, place = np.repeat(doc, n), np.repeat(hit, n)
        start = np.maximum(0, place - first[doc] - self.run_place[entry])
        # one alignment reaches half an item further on both sides, so starts within STEP words of each other are one
        found = np.unique(np.stack([doc, self.run_item[entry], start // STEP], axis=1), axis=0)
        return [(d, j, a * STEP) for d, j, a in found.tolist()]

    def answer_counts(self, words: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
        """For each item, how often its answer words stand before each block: (blocks + 1) x items."""
        at = np.searchsorted(self.rare, words)
        at[at == len(self.rare)] = 0
        hit = np.flatnonzero(self.rare[at] == words) if len(self.rare) else np.empty(0, np.int64)
        n = self.rare_count[at[hit]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.rare_item[np.repeat(self.rare_first[at[hit]], n) + within]
        counts = np.bincount(np.repeat(block[hit], n) * len(self.ids) + item, minlength=blocks * len(self.ids)).reshape(blocks, -1)
        return np.concatenate([np.zeros((1, counts.shape[1]), np.int32), np.cumsum(counts, axis=0, dtype=np.int32)])

    def verify(self, j: int, words: np.ndarray, start: int, end: int, verbatim: float, loose: float, answer: float) -> tuple[float, float] | None:
        n = len(self.words[j])
        own = words[max(0, start - n // 2 - STEP) : end + n // 2 + STEP]
        if n < 8:
            near = np.lib.stride_tricks.sliding_window_view(own, n) if len(own) >= n else own[:0].reshape(0, n)
            return (1.0, 1.0) if (near == self.words[j]).all(axis=1).any() else None
        region = own.tolist()
        # the answer first: it takes a fraction of the alignment's time and every match needs half of it
        hit = len(self.answers[j].intersection(region)) / len(self.answers[j])
        if hit < min(0.5, answer):
            return None
        share = longest_common(self.bits[j], n, region) / n
        return (share, hit) if share >= verbatim and hit >= 0.5 or share >= loose and hit >= answer else None


def _search(items: Items, basis: np.ndarray, cosine: float, verbatim: float, loose: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.concatenate([basis, np.zeros((1, basis.shape[1]), np.float32)])
        sides = [np.flatnonzero(items.window == k) for k in range(len(WINDOWS))]
        short = [j for j, w in enumerate(items.words) if len(w) < 8]
        for chunk in _chunks(batches):
            sizes = np.array([len(b) // 4 for _, b in chunk])
            words = np.frombuffer(b"".join(b for _, b in chunk), "<u4")
            first = np.concatenate([[0], np.cumsum(sizes)])
            count = -(-sizes // STEP)
            starts = np.concatenate([np.arange(a, a + n, STEP) for a, n in zip(first[:-1], sizes, strict=True)]) if len(words) else np.empty(0, np.int64)
            owner = np.repeat(np.arange(len(chunk)), count)
            if not len(starts):
                continue
            # a row of STEP terms for each block; the last block of a document is filled up with a term of weight 0
            own = np.full(len(starts) * STEP, TERMS, np.int32)
            shift = np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1] * STEP - first[:-1], sizes)
            own[np.arange(len(words)) + shift] = words & np.uint32(TERMS - 1)
            sums = full[own[::STEP]]
            for j in range(1, STEP):
                sums += full[own[j::STEP]]
            total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
            last = np.repeat(np.cumsum(count), count)  # blocks of a document end here
            opening = last - np.repeat(count, count)
            block = np.repeat(np.arange(len(starts)), np.minimum(STEP, np.repeat(first[1:], count) - starts))
            answers = items.answer_counts(words.astype(np.int64), block, len(starts))
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            for k, size in enumerate(WINDOWS):
                if not len(sides[k]):
                    continue
                span = size // STEP
                # one that the document's end cuts short is that of its last words
                here = np.arange(len(starts))
                stop = np.minimum(here + span, last[here])
                begin = np.maximum(stop - span, opening[here])
                window = (total[stop] - total[begin]).astype(np.float32)
                window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
                hits = []
                for low in range(0, len(window), _SLICE):
                    near = window[low : low + _SLICE] @ items.vectors[sides[k]].T
                    i, j = np.nonzero(near >= cosine)
                    hits.append((i + low, j, near[i, j]))
                at, item, score = (np.concatenate(x) for x in zip(*hits, strict=True))
                # no match without half of the answer words nearby: counted by blocks, and word by word in verify
                reach = -(-np.array([len(items.words[j]) for j in sides[k]]) // (2 * STEP)) + 2
                low, high = np.maximum(begin[at] - reach[item], opening[here[at]]), np.minimum(begin[at] + span + reach[item], last[here[at]])
                likely = answers[high, sides[k][item]] - answers[low, sides[k][item]] >= items.needed[sides[k][item]]
                at, item, score = at[likely], item[likely], score[likely]
                for x in np.argsort(-score, kind="stable").tolist():
                    i, j = int(at[x]), int(sides[k][item[x]])
                    d = int(owner[here[i]])
                    if (d, j) not in found:
                        text = words[first[d] : first[d + 1]]
                        a = int(starts[begin[i]] - first[d])
                        if good := items.verify(j, text, a, a + size, verbatim, loose, answer):
                            found[d, j] = (float(score[x]), *good)
            for d, j, a in items.anchored(words, first):  # runs of words that the vectors may have missed
                if (d, j) not in found and (good := items.verify(j, words[first[d] : first[d + 1]], a, a + len(items.words[j]), verbatim, loose, answer)):
                    found[d, j] = (1.0, *good)
            for j in short:  # too short for a window: found by their words
                n = len(items.words[j])
                hits = np.flatnonzero(words[: len(words) - n + 1] == items.words[j][0]) if len(words) >= n else []
                for a in hits:
                    d = int(np.searchsorted(first, a, side="right") - 1)
                    if a + n <= first[d + 1] and (words[a : a + n] == items.words[j]).all():
                        found[d, j] = (1.0, 1.0, 1.0)
            if found:
                keys = sorted(found)
                columns = [[chunk[d][0] for d, _ in keys], [items.ids[j] for _, j in keys], *([found[x][i] for x in keys] for i in range(3))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _MATCHES.split(", ")])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 44, cosine: float = 0.4, verbatim: float = 0.8, loose: float = 0.6, answer: float = 0.75, block_items: int = 500) -> DataFrame:
    """doc_id, item_id, similarity, overlap (share of the item's words in order), answer of every leaked item."""
    spark = docs.sparkSession
    ids = tokenized(docs)
    idf, passages = term_weights(ids)
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    result = spark.createDataFrame([], _MATCHES)
    if not passages:
        return result
    basis = latent_basis(ids, idf, rank)
    cache = _Ids()
    block: list[tuple[int, np.ndarray]] = []

    def searched(block: list[tuple[int, np.ndarray]]) -> DataFrame:
        known = np.unique(np.concatenate([w for _, w in block]))
        return ids.mapInArrow(_search(Items(block, basis, known, passages_with(ids, known)), basis, cosine, verbatim, loose, answer), _MATCHES)

    blocks = []
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        words = word_ids(row["text"], cache)
        if len(words):
            block.append((row["item_id"], words))
        if len(block) == block_items:
            blocks.append(searched(block))
            block = []
    if block:
        blocks.append(searched(block))
    for part in blocks:
        result = result.unionByName(part)
    return result.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("overlap").alias("overlap"), F.max("answer").alias("answer"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found; rows without a doc_id or text stay."""
    leaked = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
