"""Token ids as shards of separately compressed documents with one shared dictionary.

File format: two Parquet tables in one folder, written by Spark's committer, so
that it works on any store and survives lost executors.

``dictionary``  one row: sha256, the zstandard dictionary, the width of an id.
``blocks``      rows of up to ``block_ids`` ids: shard, sequence in the shard,
                ids of the shard before the block, the dictionary's sha256, the
                least and greatest doc_id (for pruning), and the offset index (doc_ids, n_tokens, byte offsets) beside one
                blob of zstandard frames, a frame for each document.

A short document is read by one slice of the blob: no other frame is touched.

Null text is an empty document: its only id is the end id.  Documents are in
ascending doc_id (null first), equal doc_ids in the order of their texts.  An
empty table gives no blocks.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder, public_path

END_ID = 2

_BLOCKS = "shard long, block long, ids_before long, n_ids long, dictionary string, least_doc long, greatest_doc long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"


def _train(file: str, end_id: int, width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, spaced=False)
        end = np.array([end_id], "<u4").tobytes()
        samples = []
        for batch in batches:
            for ids in enc.encode([x or "" for x in batch.column("text").to_pylist()]):
                samples.append(np.frombuffer(ids + end, "<u4").astype(f"<u{width}").tobytes())
        data = b""
        if samples:
            try:
                data = zstandard.train_dictionary(size, samples).as_bytes()
            except zstandard.ZstdError:  # too few samples: their own bytes serve as the dictionary
                data = b"".join(samples)[-size:]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return run


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _write_blocks(file: str, end_id: int, width: int, data: bytes, sha: str, block_ids: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(file, spaced=False)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_content_size=True, write_checksum=False)
        end = np.array([end_id], "<u4").tobytes()
        block = before = 0
        docs: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def flush() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(x) for x in frames]).tolist()]
            n = sum(counts)
            known = [d for d in docs if d is not None]
            values = [[shard], [block], [before], [n], [sha], [min(known, default=None)], [max(known, default=None)], [docs], [counts], [offsets], [b"".join(frames)]]
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            names = [x.split()[0] for x in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                ids += end
                docs.append(doc)
                counts.append(len(ids) // 4)
                frames.append(pack.compress(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()))
                held += counts[-1]
                if held >= block_ids:
                    yield flush()
                    before, block = before + held, block + 1
                    docs, counts, frames, held = [], [], [], 0
        if docs:
            yield flush()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, dictionary_bytes: int = 65536, sample_docs: int = 1000, block_ids: int = 250_000, level: int = 3) -> None:
    """Encode all documents and write the two tables under ``path``.

    The dictionary is trained on the ``sample_docs`` documents whose doc_id has
    the least hash: a bounded sample, which only the compression ratio depends on.
    """
    spark = docs.sparkSession
    file = tokenizer or public_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    width = 2 if max(end_id, Tokenizer.from_file(file).get_vocab_size() - 1) < 65536 else 4
    docs = docs.select("doc_id", "text")
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").coalesce(1)
    row = sample.mapInArrow(_train(file, end_id, width, dictionary_bytes), "data binary").first()
    data = bytes(row["data"]) if row else b""
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data), width)], "dictionary string, data binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write_blocks(file, end_id, width, data, sha, block_ids, level), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _read_blocks(dictionaries: dict[str, tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {sha: (zstandard.ZstdDecompressor(dict_data=_dictionary(data)), width) for sha, (data, width) in dictionaries.items()}
        for batch in batches:
            cols = [batch.column(c) for c in ("dictionary", "first_id", "doc_ids", "n_tokens", "offsets", "frames")]
            for i in range(batch.num_rows):
                sha, start, docs, counts, offsets = (c[i].as_py() for c in cols[:5])
                blob = memoryview(cols[5][i].as_buffer())
                unpack, width = readers[sha]
                starts, crcs = [], []
                for n, a, b in zip(counts, offsets[:-1], offsets[1:], strict=True):
                    ids = np.frombuffer(unpack.decompress(blob[a:b]), f"<u{width}")
                    if len(ids) != n:
                        raise ValueError(f"a frame holds {len(ids)} ids, its index says {n}")
                    starts.append(start)
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, counts, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored frames.

    A shard's place in the whole comes from one total for each shard; there are
    as many shards as write tasks, so that table is small.
    """
    dictionaries = {r["dictionary"]: (bytes(r["data"]), r["width"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = blocks.join(F.broadcast(totals), "shard").withColumn("first_id", F.col("ahead") + F.col("ids_before"))
    return placed.select("dictionary", "first_id", "doc_ids", "n_tokens", "offsets", "frames").mapInArrow(_read_blocks(dictionaries), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id: blocks are pruned by their doc_ids, and only its frames are decompressed."""
    held = {r["dictionary"]: (bytes(r["data"]), r["width"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    found = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").filter((F.col("least_doc") <= doc_id) & (F.col("greatest_doc") >= doc_id)).filter(F.array_contains("doc_ids", doc_id)).orderBy("shard", "block")
    hit = F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i) == doc_id)
    frame = F.expr("substring(frames, CAST(offsets[at - 1] + 1 AS INT), CAST(offsets[at] - offsets[at - 1] AS INT))")
    rows = found.withColumn("at", F.explode(hit)).select("dictionary", frame.alias("frame")).collect()
    out = []
    for r in rows:
        data, width = held[r["dictionary"]]
        raw = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress(bytes(r["frame"]))
        out.append(np.frombuffer(raw, f"<u{width}").tolist())
    return out
