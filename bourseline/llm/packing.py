"""Harmonic packing of documents into training sequences.

A piece of length L belongs to class k when 1/(k+1) < L/capacity <= 1/k, and
every sequence of class k holds exactly k pieces.  A length that would leave
more than ``slack`` of a sequence empty is cut at the next reciprocal first,
so a class's sequences are nearly full whatever lengths meet in them.

Each task fills sequences of its own.  What is left over, fewer than k pieces
for each class and task, is numbered through per class from counts alone and
fills further sequences of k; at last fewer than k pieces remain for each
class.  There are about 2*sqrt(capacity) classes, so these last pieces are
bounded by the capacity and not by the data; they are placed together, the
longest first.

Null text is an empty document: its only id is the end id.  Repeated rows and
doc_ids are packed as often as they stand in the input.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, public_path

CAPACITY = 2048
END_ID = 1

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, k long, nth long, sequence_id long, `offset` long"
_RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cut_lengths(total: int, capacity: int, slack: float, tail: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, then reciprocals, then a rest that fits its class."""
    cuts = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        if rest <= tail or k * rest >= (1 - slack) * capacity:
            cuts.append(rest)
            break
        head = capacity // (k + 1)
        cuts.append(head)
        rest -= head
    return cuts


def _cut_documents(file: str, end_id: int, capacity: int, slack: float, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        enc = encoder(file, spaced=True)
        held: dict[int, list[list[int]]] = {}  # class -> fewer than k pieces
        made = 0
        cuts: dict[int, list[int]] = {}
        names = [x.split()[0].strip("`") for x in _PIECES.split(", ")]
        for batch in batches:
            rows: list[list[int]] = []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                ids += end
                total, start = len(ids) // 4, 0
                if total not in cuts:
                    cuts[total] = cut_lengths(total, capacity, slack, tail)
                for length in cuts[total]:
                    k = capacity // length
                    row = [doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, part, k, None, None, None]
                    start += length
                    bin_ = held.setdefault(k, [])
                    bin_.append(row)
                    if len(bin_) == k:
                        at = 0
                        for r in bin_:
                            r[8], r[9] = (part << 32) | made, at
                            at += r[2]
                        made += 1
                        rows += bin_
                        held[k] = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
            if len(cuts) > 100_000:
                cuts.clear()
        left = []
        for bin_ in held.values():
            for i, r in enumerate(bin_):
                r[7] = i
                left.append(r)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*left, strict=True)], names=names)

    return run


def _place_last(capacity: int, first_id: int):
    """Longest first into the first sequence with room; the rows are bounded by the capacity."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]).to_pylist()
        rows.sort(key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["part"], r["nth"]))
        room: list[int] = []
        for r in rows:
            at = next((i for i, free in enumerate(room) if free >= r["length"]), len(room))
            if at == len(room):
                room.append(capacity)
            r["sequence_id"], r["offset"] = first_id + at, capacity - room[at]
            room[at] -= r["length"]
        return pa.table({c: pa.array([r[c] for r in rows], pa.int64()) for c in _RESULT})

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, slack: float = 0.01, tail: int = 16) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    file = tokenizer or public_path("byte_bpe_50k.json")
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_cut_documents(file, end_id, capacity, slack, tail), _PIECES), "pieces")
    done = pieces.filter("sequence_id IS NOT NULL").select(*_RESULT)
    left = pieces.filter("sequence_id IS NULL")
    counts = left.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("k")).alias("all"))
    ranked = left.join(counts, ["k", "part"]).withColumn("rank", F.col("ahead") + F.col("nth")).withColumn("bin", F.floor(F.col("rank") / F.col("k")).cast("long"))
    full = (F.col("bin") + 1) * F.col("k") <= F.col("all")
    shared_id = F.lit(1 << 60) + F.col("k") * F.lit(1 << 44) + F.col("bin")
    within = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    shared = ranked.filter(full).withColumn("sequence_id", shared_id).withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select(*_RESULT)
    last = ranked.filter(~full).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_place_last(capacity, 1 << 61), ", ".join(f"`{c}` long" for c in _RESULT))
    return done.unionByName(shared).unionByName(last)


def pack_summary(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, ids and padding, where a sequence of a power-of-two length is not padded."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    padded = F.when(F.expr("bit_count(used) = 1"), F.col("used")).otherwise(F.lit(capacity))
    return per.agg(F.count("*").alias("sequences"), F.sum("used").alias("ids"), F.sum(padded - F.col("used")).alias("padding"))
