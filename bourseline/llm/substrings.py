"""Exact removal of repeated word windows by De Bruijn edges with source coordinates.

A window of ``size`` words is an edge between its two (size-1)-word ends and is
known by a 64-bit hash.  Documents are written once in batches.  Every batch
sends, for each bucket of hashes, its distinct edges with the coordinates
(doc_id, word) of the least occurrence, packed by byte planes; nothing larger
than one entry for an edge and batch is shuffled, however often an edge
repeats.  A bucket finds each edge's least coordinates over all batches and
answers the batches whose own occurrence is not in the least document.  The
answers are joined to the batches; there, consecutive repeated edges whose
source coordinates advance together are one nonbranching path and compact into
one span (document, start, length, source, source start).

``verified`` joins spans to their source documents and compares the words at
the coordinates; ``repeated_spans`` returns only spans that hold.

Words are maximal runs of other than the six ASCII white-space characters,
unchanged.  Null text has no words.  Rows without a doc_id are kept whole and
are nobody's source.  Rows that share a doc_id never cut each other.  Repeated
rows give a row each.  Texts under ``size`` words are kept whole.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

SIZE = 13
_BATCH = "batch long, docs array<long>, sizes array<int>, words binary"
_EDGES = "bucket int, batch long, n int, entries binary"
_ANSWER = "batch long, bucket int, at binary, source_doc binary, source_word binary"
_SPANS = "doc_id long, start long, n_words long, source_doc long, source_start long"
_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


def _to_batches(size: int):
    """Rows of about ``size`` words: the documents' words, joined by one space each, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3)
        docs, sizes, words, held, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            values = [[part << 32 | number], [docs], [sizes], [pack.compress(b" ".join(words))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["batch", "docs", "sizes", "words"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = text.encode("utf-8", "surrogatepass").split()
                docs.append(doc)
                sizes.append(len(own))
                if own:
                    words.append(b" ".join(own))
                held += len(own) + 1
                if held >= size:
                    yield flush()
                    docs, sizes, words, held, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return run


class Batch:
    """One batch's words and edges."""

    def __init__(self, docs: list[int | None], sizes: list[int], words: bytes, size: int, hashes: dict[bytes, int]):
        self.docs, self.sizes = docs, np.array(sizes, np.int64)
        self.words = zstandard.ZstdDecompressor().decompress(words).split(b" ") if self.sizes.any() else []
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        n = len(self.words) - size + 1
        if n < 1:
            self.edges = np.empty(0, np.uint64)
            self.at = self.doc = self.word = np.empty(0, np.int64)
            return
        h = np.fromiter((hashes[w] for w in self.words), np.uint64, len(self.words))
        edges = np.zeros(n, np.uint64)
        for j in range(size):
            edges = edges * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        edges ^= edges >> np.uint64(29)
        edges *= np.uint64(0xBF58476D1CE4E5B9)
        edges ^= edges >> np.uint64(32)
        owner = np.repeat(np.arange(len(sizes)), self.sizes)
        known = np.array([d is not None for d in docs])
        inside = (owner[: n] == owner[size - 1 : size - 1 + n]) & known[owner[:n]]
        self.at = np.flatnonzero(inside)
        self.edges = edges[self.at]
        ids = np.array([0 if d is None else d for d in docs], np.int64)
        self.doc = ids[owner[self.at]]  # doc_id of each edge
        self.word = self.at - self.first[owner[self.at]]  # its place in the document

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The places (in ``edges``) of each distinct edge's least occurrence by falling hash order, and each edge's group."""
        order = np.lexsort((self.word, self.doc, self.edges))
        own = self.edges[order]
        new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.empty(0, bool)
        group = np.empty(len(own), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], group


def _planes(values: np.ndarray, width: int = 8) -> bytes:
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unplanes(data: bytes, n: int, width: int = 8) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(-1)


def _rows(batch: pa.RecordBatch, size: int, hashes: dict) -> Iterator[tuple[int, Batch, int]]:
    for i in range(batch.num_rows):
        number, docs, sizes, words = (batch.column(c)[i].as_py() for c in ("batch", "docs", "sizes", "words"))
        yield number, Batch(docs, sizes, words, size, hashes), i


def _bounds(edges: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted edges; a bucket is a range of hashes."""
    steps = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(edges, steps), len(edges))


def _send(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        pack = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            for number, batch, _ in _rows(rows, size, hashes):
                at, _ = batch.distinct()
                edges, docs, places = batch.edges[at], batch.doc[at], batch.word[at]
                cut = _bounds(edges, buckets)
                out = []
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    s = slice(cut[b], cut[b + 1])
                    own = edges[s]
                    steps = np.diff(own, prepend=np.uint64(0))
                    data = pack.compress(_planes(steps) + _planes(docs[s].view(np.uint64)) + _planes(places[s], 4))
                    out.append((b, number, len(own), data))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "batch", "n", "entries"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For one bucket: which entries of which batches have a lesser document elsewhere, and where."""
    batches, counts = table.column("batch").to_pylist(), table.column("n").to_pylist()
    unpack = zstandard.ZstdDecompressor()
    edges, docs, places = [], [], []
    for n, blob in zip(counts, table.column("entries"), strict=True):
        data = unpack.decompress(blob.as_py())
        edges.append(np.cumsum(_unplanes(data[: 8 * n], n), dtype=np.uint64))
        docs.append(_unplanes(data[8 * n : 16 * n], n).view(np.int64))
        places.append(_unplanes(data[16 * n :], n, 4))
    first = np.concatenate([[0], np.cumsum(counts)])
    edge, doc, place = np.concatenate(edges), np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((place, doc, edge))
    own = edge[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    least = np.empty(len(own), np.int64)
    least[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = doc[least] < doc
    bucket = table.column("bucket")[0].as_py()
    pack = zstandard.ZstdCompressor(level=1)
    out = []
    for i, number in enumerate(batches):
        hit = np.flatnonzero(later[first[i] : first[i + 1]])
        if len(hit):
            source = least[first[i] + hit]
            out.append((number, bucket, pack.compress(hit.astype("<u4").tobytes()), pack.compress(doc[source].astype("<i8").tobytes()), pack.compress(place[source].astype("<u4").tobytes())))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ["batch", "bucket", "at", "source_doc", "source_word"]
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _resolve(batch: Batch, answers: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every edge of a batch: is it repeated from a lesser document, that document, and the place there."""
    at, group = batch.distinct()
    cut = _bounds(batch.edges[at], buckets)
    unpack = zstandard.ZstdDecompressor()
    doc, word = batch.doc[at].copy(), batch.word[at].copy()
    for a in answers or []:
        hit = cut[a["bucket"]] + np.frombuffer(unpack.decompress(a["at"]), "<u4").astype(np.int64)
        doc[hit] = np.frombuffer(unpack.decompress(a["source_doc"]), "<i8")
        word[hit] = np.frombuffer(unpack.decompress(a["source_word"]), "<u4")
    source, place = doc[group], word[group]
    return source < batch.doc, source, place


def _finish(size: int, buckets: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for rows in batches:
            answers = rows.column("answers").to_pylist()
            for _, batch, i in _rows(rows, size, hashes):
                if len(batch.edges):
                    repeated, source, place = _resolve(batch, answers[i], buckets)
                    hit = np.flatnonzero(repeated)
                else:
                    hit = source = place = np.empty(0, np.int64)
                at = batch.at[hit]
                if spans:
                    if len(hit):
                        # a path goes on while word, document and source coordinates advance together
                        doc, word, s, p = batch.doc[hit], batch.word[hit], source[hit], place[hit]
                        go = (at[1:] == at[:-1] + 1) & (s[1:] == s[:-1]) & (p[1:] == p[:-1] + 1) & (word[1:] == word[:-1] + 1)
                        begin = np.flatnonzero(np.concatenate([[True], ~go]))
                        length = np.diff(np.append(begin, len(hit))) + size - 1
                        yield pa.RecordBatch.from_arrays([pa.array(x[begin] if x is not length else x, pa.int64()) for x in (doc, word, length, s, p)], names=[x.split()[0] for x in _SPANS.split(", ")])
                    continue
                change = np.zeros(len(batch.words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + size, -1)
                cut = np.cumsum(change[:-1]) > 0
                out = []
                for d, doc in enumerate(batch.docs):
                    a, b = int(batch.first[d]), int(batch.first[d + 1])
                    own = batch.words[a:b]
                    gone = cut[a:b]
                    n = int(gone.sum())
                    if n:
                        own = [own[j] for j in np.flatnonzero(~gone).tolist()]
                    out.append((doc, b - a, n, hashlib.sha256(b" ".join(own)).hexdigest()))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return run


def _run(docs: DataFrame, size: int, batch_words: int, spans: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    batches = stored(rows.mapInArrow(_to_batches(batch_words), _BATCH), "batches")
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = batches.mapInArrow(_send(size, buckets), _EDGES)
    answers = edges.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    told = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "at", "source_doc", "source_word")).alias("answers"))
    joined = batches.join(told, "batch", "left").select("batch", "docs", "sizes", "words", "answers")
    return joined.mapInArrow(_finish(size, buckets, spans), _SPANS if spans else _DIGEST)


def removal_digest(docs: DataFrame, size: int = SIZE, batch_words: int = 800_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document after the removal."""
    return _run(docs, size, batch_words, spans=False)


def repeated_spans(docs: DataFrame, size: int = SIZE, batch_words: int = 800_000) -> DataFrame:
    """Verified spans (doc_id, start, n_words, source_doc, source_start) of words repeated from a lesser doc_id."""
    return verified(docs, stored(_run(docs, size, batch_words, spans=True), "spans"))


def verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Those spans whose words at both coordinates agree, word by word."""
    words = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.regexp_replace(text_or_empty(), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+").alias("w"))
    part = lambda start: F.slice("w", (F.col(start) + 1).cast("int"), F.col("n_words").cast("int"))
    own = spans.join(words, "doc_id").withColumn("own", F.sha2(F.array_join(part("start"), " "), 256)).drop("w")
    source = words.withColumnRenamed("doc_id", "source_doc")
    return own.join(source, "source_doc").filter(F.sha2(F.array_join(part("source_start"), " "), 256) == F.col("own")).select(*[x.split()[0] for x in _SPANS.split(", ")]).distinct()
