"""A trie of conversations that share their first turns.

A turn is told from others by 128 bits of the SHA-256 of its role and text, so
texts stay where they are read and a conversation is one path of 16 bytes a
turn.  Equal paths become one row with their count, their least conv_id and the
digest of their ids.  Paths are dealt out by their first turn; each task builds
the tries of its first turns from a dictionary of (parent, turn) and sums them
from the leaves up, in a loop over numbers that parents have before children.
A subtrie of more turns than a task should hold is cut at its first branching
node: that node, and the unbranched ones above it, become rows of Spark, and the
paths go on by the turn after it, round by round.  The sums of cut nodes are then
added from the last round back to the root.

Rows: turns are ordered by ``turn``, null first; turns of one number, by their
digest.  A null role or text is empty, so it equals an empty one.  Rows without
a conv_id belong to no conversation.  A row that repeats another is one more
turn.  An empty table has no root.  Only ``conv_id``, ``turn``, ``role`` and
``text`` are read; further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TURN = 16
#: A subtrie is cut if it has more turns than its share, which lies between these.
SHARE = (1_000, 100_000)
#: Conversations of up to 2 ** BITS following ids reach their node as one row.
BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the digest and the words of each turn, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("t"), F.regexp_count(text, F.lit(WORDS)).alias("w"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t", "w"))).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"))).alias("turns"))


def rebuilt(own: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation after the first turns of the first one of its block; ``crc32(conv_id) % heads`` turns give way."""
    base = F.col("conv_id") - F.col("conv_id") % block
    first = own.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    met = own.withColumn("base", base).join(first, "base", "left").withColumn("h", h)
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, sorted by path and block, to one row a path; holds one digest in progress, whatever the number of ids."""
    schema = pa.schema([("path", pa.binary()), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    now, out = None, []
    for batch in batches:
        for path, words, ids, n, least in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "ids", "n", "least")), strict=True):
            if now is None or now[0] != path:
                if now is not None:
                    out.append([*now[:4], now[4].hexdigest()])
                now = [path, words, n, least, hashlib.sha256(ids.encode())]
            else:
                now[2] += n
                now[4].update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*now[:4], now[4].hexdigest()], schema, strict=True)], schema=schema)


def distinct_paths(convs: DataFrame, bits: int = BITS) -> DataFrame:
    """``path, words, n, conv_id, ends``: every different sequence of turns with its conversations' number, least id and digest of ids."""
    joined = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["t"])), ""))
    rows = convs.select("conv_id", joined.alias("path"), F.transform("turns", lambda x: x["w"]).alias("words"), F.shiftright("conv_id", bits).alias("block"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = rows.groupBy("path", "block").agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words"))
    sorted_blocks = blocks.repartition(F.col("path")).sortWithinPartitions("path", "block")
    return sorted_blocks.mapInArrow(_ends, "path binary, words array<int>, n long, conv_id long, ends string")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries of one bucket of groups; a group's top node is its turn at the group's own depth."""
    index: dict[tuple[int, bytes], int] = {}
    parent, depth, words, n, conv, ends, group = [], [], [], [], [], [], []

    def node(at: int, turn: bytes, d: int, w: int, g: int) -> int:
        found = index.setdefault((at, turn), len(parent))
        if found == len(parent):
            for column, value in ((parent, at), (depth, d), (words, w), (n, 0), (conv, None), (ends, NO_ENDS), (group, g)):
                column.append(value)
        return found

    for i, (g, path, w, count, least, end) in enumerate(zip(rows["g"], rows["path"], rows["words"], rows["n"], rows["conv_id"], rows["ends"], strict=True)):
        g, path, k = bytes(g), bytes(path), len(g) // TURN
        at = node(-1, g, k, w[k - 1], i)
        for d in range(k, len(path) // TURN):
            at = node(at, path[TURN * d : TURN * (d + 1)], d + 1, w[d], i)
        n[at], conv[at], ends[at] = n[at] + count, least if conv[at] is None else min(conv[at], least), end
    size = len(parent)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for i in range(size - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * int(words[i])
        if (p := parent[i]) >= 0:
            children[p] += 1
            n[p] += n[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
    up, above = rows["up"].tolist(), rows["pg"].tolist()
    out = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": [up[g] if p < 0 else conv[p] for p, g in zip(parent, group, strict=True)], "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})
    return out.assign(pg=[above[g] if p < 0 else None for p, g in zip(parent, group, strict=True)])


def _common_turns(lo: Column, hi: Column) -> Column:
    """The number of turns with which both of two paths begin, hence all paths between them."""
    own, other = F.length(lo) / TURN, F.length(hi) / TURN
    turn = lambda x, i: F.substring(x, i * TURN + 1, F.lit(TURN))
    places = F.sequence(F.lit(0), F.least(own, other).cast("int"))  # one place beyond, where one of them ends
    return F.element_at(F.filter(places, lambda i: ~turn(lo, i).eqNullSafe(turn(hi, i)) | (i >= own)), 1)


def _cut(open_: DataFrame, over: Column) -> DataFrame:
    """Groups of ``open_`` to cut: their first branching depth, totals, and the words of one path."""
    depth = F.length("path") / TURN - F.length("g") / TURN
    sizes = open_.groupBy("g", "pg", "up").agg(F.count("*").alias("paths"), F.sum(depth + 1).cast("long").alias("turns"), F.min("path").alias("lo"), F.max("path").alias("hi"), F.min("conv_id").alias("conv"), F.sum("n").alias("n_convs"), F.min_by("words", "path").alias("words"))
    return sizes.filter(over).withColumn("cut", _common_turns(F.col("lo"), F.col("hi")).cast("int")).drop("lo", "hi")


def _above(cuts: DataFrame, ended: DataFrame, kids: DataFrame) -> DataFrame:
    """The nodes of cut groups, from their top to the branching node; ``kids`` are the tops of the groups below."""
    sums = kids.groupBy("pg").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
    whole = cuts.join(sums.withColumnRenamed("pg", "g"), "g", "left").join(ended.select("g", "ends"), "g", "left")
    top = (F.length("g") / TURN).cast("int")
    each = whole.withColumn("d", F.explode(F.sequence(top, F.col("cut"))))
    word = F.when(F.col("d") > 0, F.get("words", F.col("d") - 1)).otherwise(0)
    gained = F.sum((F.col("n_convs") - 1) * word).over(Window.partitionBy("g").orderBy(F.col("d").desc()))
    last = F.col("d") == F.col("cut")
    return each.select(
        F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == top, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (gained + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        F.when(F.col("d") == top, F.col("pg")).alias("pg"),
    )


def trie(paths: DataFrame, share: int | None = None) -> DataFrame:
    """All nodes of the trie of ``distinct_paths``.

    ``share``: turns over which a subtrie is cut; by default what two tasks in
    each shuffle partition would get, within the bounds of ``SHARE``.
    """
    spark = paths.sparkSession
    open_ = stored(paths.withColumns({"g": F.lit(b""), "pg": F.lit(None).cast("binary"), "up": F.lit(None).cast("long")}), "paths")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = open_.agg(F.sum(F.length("path") / TURN + 1)).first()[0] or 0
    share = share or min(max(int(total) // (2 * partitions), SHARE[0]), SHARE[1])
    rounds, small, over = [], [], F.lit(True)  # the root is always cut, so that groups begin at the first turn
    while not (cuts := stored(_cut(open_, over), "cuts")).isEmpty():
        met = open_.join(cuts.select("g", "cut", F.col("conv").alias("conv_")), "g", "left")
        small.append(met.filter("cut IS NULL").select(open_.columns))
        at = F.length("path") / TURN
        rounds.append((cuts, stored(met.filter(at == F.col("cut")).select("g", "ends"), "ended")))
        key = F.substring(F.col("path"), F.lit(1), (F.col("cut") + 1) * TURN)
        below = met.filter(at > F.col("cut")).select("path", "words", "n", "conv_id", "ends", key.alias("g"), F.col("g").alias("pg"), F.col("conv_").alias("up"))
        open_, over = stored(below, "paths"), (F.col("paths") > 1) & (F.col("turns") > share)
    small.append(open_)
    buckets = max(partitions, -(-int(total) // share))
    dealt = reduce(DataFrame.unionByName, small).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    nodes = [stored(dealt.groupBy("bucket").applyInPandas(_tries, f"{_NODE}, pg binary"), "nodes")]
    for cuts, ended in reversed(rounds):
        kids = reduce(DataFrame.unionByName, [x.filter("pg IS NOT NULL").select("pg", "n_leaves", "saved_tokens") for x in nodes])
        nodes.append(stored(_above(cuts, ended, kids), "nodes"))
    return reduce(DataFrame.unionByName, nodes).drop("pg")


def shared_prefixes(conversations: DataFrame, share: int | None = None) -> DataFrame:
    """The trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    return trie(distinct_paths(rebuilt(stored(own_turns(conversations), "turns"))), share)


def prefixes(conversations: DataFrame, share: int | None = None) -> DataFrame:
    """The same for conversations as they are."""
    return trie(distinct_paths(own_turns(conversations)), share)
