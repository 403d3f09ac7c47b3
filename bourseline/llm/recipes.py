"""Exact duplicates by recipes of content-defined chunks.

A rolling hash of the last 32 bytes cuts every text into chunks, so that equal
texts are cut alike wherever they stand.  Each chunk is named by a 128-bit
digest, and a text by its recipe, the ordered list of these names.  The names
are verified: the bytes of all chunks, without repeats, are moved once and
grouped by name and bytes.  A name that two different chunks share (none is
known for this digest) is made longer by the chunk itself.  From then on only recipes move, 16 bytes a chunk, and texts are equal exactly if their
recipes are.

Rows: a null text counts as empty.  Rows that share doc_id and text are one
document: they give one row, and ``group_size`` counts all of them.  Rows that
share a doc_id but not the text are documents of their own.  A row without a
doc_id stays only where its whole group has none.  An empty table gives an
empty one.  Only ``doc_id`` and ``text`` are read; further columns may have any
name.  A copy group of any size is summed in the tasks before it is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Bytes of a chunk: none is shorter (but the last of a text), the mean is LEAST + MEAN, none is longer.
LEAST, MEAN, MOST = 512, 2048, 16_384
#: Bytes that the rolling hash sees, and bytes hashed at once.
SEEN, BLOCK = 32, 1 << 20
NAME = 16


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte value."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint32)


def boundaries(data: np.ndarray, gear: np.ndarray) -> list[int]:
    """Ends of possible chunks: where the top bits of the sum of the last 32 bytes' numbers, each doubled a step, are 0."""
    found, bar = [], np.uint32((1 << 32) // MEAN)
    for at in range(0, len(data), BLOCK):
        before = min(at, SEEN - 1)
        h = gear[data[at - before : at + BLOCK]]
        for step in (1, 2, 4, 8, 16):
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h = more
        found.append(np.flatnonzero(h[before:] < bar) + at + 1)
    return np.concatenate(found).tolist() if found else []


def chunks(start: int, end: int, ends: list[int]) -> Iterator[tuple[int, int]]:
    """The chunks of the text that lies at ``start:end``.  The least length exceeds what the hash sees, so bytes before ``start`` count for nothing."""
    while start < end:
        i = bisect_left(ends, start + LEAST)
        stop = min(end, start + MOST, ends[i] if i < len(ends) else end)
        yield start, stop
        start = stop


def name_of(piece: memoryview, size: int) -> bytes:
    return xxhash.xxh3_128_digest(piece)[:size].ljust(NAME, b"\0")


def _cut(batch: pa.RecordBatch, gear: np.ndarray) -> Iterator[list[memoryview]]:
    """The chunks of each text of a batch."""
    texts = batch.column("text")
    data = memoryview(texts.buffers()[2] or b"")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    ends = [e + at[0] for e in boundaries(np.frombuffer(data, np.uint8)[at[0] : at[-1]], gear)]
    for a, b in zip(at, at[1:], strict=False):
        yield [data[x:y] for x, y in chunks(a, b, ends)]


def _recipes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    gear = _gear()
    for batch in batches:
        shas, recipes = [], []
        for pieces in _cut(batch, gear):
            sha = hashlib.sha256()
            for piece in pieces:
                sha.update(piece)
            shas.append(sha.hexdigest())
            recipes.append(b"".join([name_of(p, size) for p in pieces]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], ["doc_id", "text_sha256", "recipe"])


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Chunks by name, each once a batch."""
    gear = _gear()
    for batch in batches:
        found = {(name_of(p, size), bytes(p)) for pieces in _cut(batch, gear) for p in pieces}
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["name", "piece"])


def _rows_of_pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Every chunk with its row, place, name and bytes."""
    gear = _gear()
    for batch in batches:
        rows = [(row, i, name_of(p, size), bytes(p)) for row, pieces in zip(batch.column("row").to_pylist(), _cut(batch, gear), strict=True) for i, p in enumerate(pieces)]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["row", "place", "name", "piece"])


def chunk_table(docs: DataFrame, size: int = NAME) -> DataFrame:
    """``name, piece``: every different chunk of all texts, once."""
    texts = docs.select(text_or_empty().alias("text"))
    return texts.mapInArrow(partial(_pieces, size=size), "name binary, piece binary").distinct()


def recipes(docs: DataFrame, size: int = NAME) -> DataFrame:
    """``doc_id, text_sha256, recipe`` of every row.  ``size`` shortens the digest, so that tests can make names meet."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = texts.mapInArrow(partial(_recipes, size=size), "doc_id long, text_sha256 string, recipe binary")
    pieces = chunk_table(docs, size)
    shared = stored(pieces.groupBy("name").count().filter("count > 1").select("name"), "shared")
    return own if shared.isEmpty() else _numbered(texts, shared, size)


def _numbered(texts: DataFrame, shared: DataFrame, size: int) -> DataFrame:
    """Recipes in which each chunk of a shared name is there with its bytes."""
    rows = stored(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    pieces = stored(rows.mapInArrow(partial(_rows_of_pieces, size=size), "row long, place int, name binary, piece binary"), "pieces")
    mixed = shared.withColumn("mixed", F.lit(True))
    # the bytes themselves tell the variants of a shared name apart
    own = F.when(F.col("mixed"), F.hex("piece")).otherwise("")
    names = pieces.join(mixed, "name", "left").select("row", "place", F.concat(F.hex("name"), F.lit(":"), own).alias("id"))
    lists = names.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").cast("binary").alias("recipe"))
    return rows.join(lists, "row", "left").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.coalesce("recipe", F.lit(b"")).alias("recipe"))


def exact_groups(docs: DataFrame, size: int = NAME) -> DataFrame:
    """Every document with the document that stays of its group of equal texts: the one of largest doc_id.

    ``doc_id, keep_id, group_size, kept, text_sha256``
    """
    own = stored(recipes(docs, size).groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("n")), "recipes")
    groups = stored(own.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("members")).filter("members > 1").drop("members"), "groups")
    met = own.join(groups, "recipe", "left").withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
    return met.select("doc_id", "keep_id", F.coalesce("group_size", "n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group of equal texts, all columns as they are."""
    groups = exact_groups(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.sha2(text_or_empty(), 256).alias("sha"))
    numbered = groups.filter("kept").select(F.col("id").alias("id_"), F.col("sha").alias("sha_"))
    return rows.join(numbered, F.col("id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left_semi").dropDuplicates(["id", "sha"]).select("row.*")
