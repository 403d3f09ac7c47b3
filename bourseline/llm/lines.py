"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to lower-case words with digits as 0.  Lines of fewer than
``min_words`` words are left alone, or with ``short`` go if they equal an
earlier line.  Lines with equal normal forms are one distinct line (128-bit
hash).  Each has a 128-bit SimHash of its set of words, lines of few words (also)
one of their character trigrams.  The bits are cut into pigeonhole blocks of
``k`` bits under several orders of the bits; two lines meet if they agree on a
block, and are candidates if 88 bits of their hashes differ in at most ``NEAR_ALL`` and
their lengths allow the similarity.  ``k`` and the blocks are the same for every input, so
whether two lines meet never depends on other lines; there are so many blocks that a tenth of the bits may
differ (``MISSED``).  The blocks take their turns in rounds, so that what is shuffled at a time is a share of it all.  Candidates are verified by the edit
similarity of their normal forms, and each connected group keeps its first
occurrence, the least (doc_id, line).

All candidates of a group are verified, but for those that are connected
already (each line meets its least candidate first): in a crowded group each line gives its least candidate; then a few
leaders, which are lines outside the largest component, are compared to their candidates, and what other links leave
unconnected goes on with sixteen times as many leaders, until all outside the largest component have led.

Null text has no lines and stays null.  Rows without a doc_id are kept whole
and are nobody's first occurrence.  Rows that repeat a doc_id with its text are
cut alike.  Empty lines stay where they are.  An empty table gives an empty
result.  Input columns are kept as they are, but for the text and for columns
that have a result's name.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import all_within, by_bits, trimmed
from .common import plain_names, BROADCAST_IDS, discard, forget, stored
from .graph import components
from .near_dup import mixed

BITS = 3  # hashes that differ in so many bits always agree on a block
NEAR, NEAR_ALL = 12, 18  # greatest difference of two candidates' hashes, of 56 bits and of all 88 that travel with a block
SCALE = 0.045  # lengths are compared by the whole part of their logarithm over this
MISSED = 0.0002  # share of lines that meet on no block when a tenth of the bits differs
WIDTH = 16  # bits of a block: 100 million lines are groups of about 1,500 on average, were their hashes random
ROUND = 7  # blocks of one round at least: shuffled entries of a round are gone before the next begins
ENTRIES = 10_000_000  # entries of a round, if that is more
_FEW = 4  # candidates of one member up to which all pairs of a group are given at once
_CROWD = 16  # later candidates of one member after which leaders find the others

_ODD = re.compile(r"[\W_]+")
_DIGIT = re.compile(r"\d")
_OCCURRENCES = "doc_id long, t long, line int, length int, a long, b long, s long, z long, g long, h long"
#: kind 0: candidates x, y; kind 1: group x, its member y, the member's hash z and more of it.
_MET = "kind int, x long, y long, z long, more long"
#: A byte's bits as eight counters of one byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)
_STEP = 254  # features that such counters can add up
_MOST_POWERS = 1 << 18


def normalised(line: str) -> str:
    return _DIGIT.sub("0", _ODD.sub(" ", line.lower())).strip()


@cache
def _folds() -> np.ndarray:
    """For each code point what stands for it in a normal form: itself, 0 for a digit, a space, or a line's end."""
    chars = map(chr, range(sys.maxunicode + 1))
    return np.array([48 if c.isdecimal() else ord(c) if c.isalnum() else 10 if c == "\n" else 32 for c in chars], np.uint32)


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and their inverses, of 64 bits."""
    out = np.full((2, _MOST_POWERS), base, np.uint64)
    out[1] = pow(base, -1, 1 << 64)
    out[:, 0] = 1
    return tuple(np.cumprod(out, axis=1, dtype=np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of runs of values that follow each other."""
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, inverse = _powers(base)
    if len(values) <= len(powers):
        return mixed(np.add.reduceat((values + np.uint64(1)) * powers[: len(values)], starts) * inverse[starts])
    # longer ones in pieces of whole runs; a run that is longer than that by itself has its own powers
    cuts, ends = [0], np.append(starts[1:], len(values))
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, starts[cuts[-1]] + len(powers), side="right"))))
    out = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = values[starts[i] : ends[j - 1]]
        if len(own) <= len(powers):
            out.append(run_hashes(own, starts[i:j] - starts[i], base))
        else:
            alone = np.full(len(own), base, np.uint64)
            alone[0] = 1
            out.append(mixed(np.array([((own + np.uint64(1)) * np.cumprod(alone, dtype=np.uint64)).sum(dtype=np.uint64)])))
    return np.concatenate(out)


def simhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of runs of feature hashes."""
    sizes = np.diff(np.append(starts, len(hashes)))
    parts = -(-sizes // _STEP)  # runs are added up in parts that the counters hold
    first = np.cumsum(parts) - parts
    begin = np.repeat(starts, parts) + _STEP * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    counts = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], begin, axis=0).view(np.uint8).reshape(-1, 64)
    ones = np.add.reduceat(counts, first, axis=0, dtype=np.int32) if (parts > 1).any() else counts.astype(np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(np.int64).reshape(-1)


def length_class(length: np.ndarray) -> np.ndarray:
    """Classes of lengths, 0 to 255."""
    return np.minimum(255, np.log(np.maximum(length, 1)) / SCALE).astype(np.int64)


def _candidates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the first 56 bits of hashes are near; the last byte is the class of the length."""
    return np.bitwise_count((x ^ y) >> np.uint64(8)) <= NEAR


def _apart(similarity: float) -> int:
    """Most that the classes of two lengths may differ."""
    return math.ceil(-math.log(similarity) / SCALE)


def _sure(sim: np.ndarray, more: np.ndarray, i: np.ndarray | int, j: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the candidates ``j`` whose further bits and lengths agree as well: which of them stay."""
    x, y = sim[i], sim[j]
    lengths = np.abs((x & np.uint64(255)).astype(np.int64) - (y & np.uint64(255)).astype(np.int64)) <= _apart(similarity)
    return lengths & (np.bitwise_count((x ^ y) >> np.uint64(8)) + np.bitwise_count(more[i] ^ more[j]) <= NEAR_ALL)


def _halves(owner: np.ndarray, features: np.ndarray, lines: int) -> list[pa.Array]:
    """128-bit SimHashes of each line's set of features; null for a line without one."""
    keys = np.sort(owner.astype(np.uint64) << np.uint64(40) | features & np.uint64((1 << 40) - 1))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    out, none = np.zeros((2, lines), np.int64), np.ones(lines, bool)
    if len(keys):
        line = (keys >> np.uint64(40)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        flat = mixed(keys & np.uint64((1 << 40) - 1))
        none[line[starts]] = False
        out[0, line[starts]], out[1, line[starts]] = simhashes(flat, starts), simhashes(mixed(flat + np.uint64(1)), starts)
    return [pa.array(x, pa.int64(), mask=none) for x in out]


def _hashed(docs: list[int], keys: list[int], texts: list[str], least: int, min_words: int) -> pa.RecordBatch:
    """Every line of at least ``least`` words of some texts, with the hash of its words and its SimHashes."""
    texts = [x.lower() for x in texts]
    lines_of = np.array([x.count("\n") + 1 for x in texts])
    buffer = _folds()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")]
    edge = np.diff((buffer > 32).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = ends - starts
    inner = np.cumsum(sizes) - sizes
    word = run_hashes(buffer[buffer > 32].astype(np.uint64), inner, 0x9E3779B97F4A7C15)
    line_ends = np.flatnonzero(buffer == 10)
    owner = np.searchsorted(line_ends, starts)
    number = np.bincount(owner, minlength=len(line_ends))
    kept = np.flatnonzero(number >= least)
    chosen = (number >= least)[owner]
    word, owner, starts, ends = word[chosen], (np.cumsum(number >= least) - 1)[owner[chosen]], starts[chosen], ends[chosen]
    number = number[kept]
    first = np.cumsum(number) - number
    a, b = (run_hashes(word, first, p).view(np.int64) for p in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
    # lines of 6 to 10 words have both hashes, so that no edit parts two lines by their number of words
    long_, short = (number >= max(6, min_words))[owner], (number <= 10) & (number >= min_words)
    at = np.flatnonzero(short)
    grams, where = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if len(at):
        spread = np.where(short[owner], ends - starts, 0)  # each word's trigrams lie in " word "
        begin = np.repeat(starts, spread) + np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
        padded = np.concatenate([[np.uint32(32)], buffer]).astype(np.uint64)
        padded[padded == 10] = 32
        grams.append(mixed(padded[begin] | padded[begin + 1] << np.uint64(21) | padded[begin + 2] << np.uint64(42)))
        where.append(np.repeat(owner, spread))
    before = np.cumsum(lines_of) - lines_of
    doc = np.repeat(np.arange(len(docs)), lines_of)[kept]
    spelt = np.add.reduceat(ends - starts, first) + number - 1 if len(first) else number
    columns = [np.array(docs, np.int64)[doc], np.array(keys, np.int64)[doc], kept - before[doc], length_class(spelt), a, b]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    own = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*own, *_halves(owner[long_], word[long_], len(kept)), *_halves(np.concatenate(where), np.concatenate(grams), len(kept))], names=[x.split()[0] for x in _OCCURRENCES.split(", ")])


def _occurrences(min_words: int, least: int, size: int = 150_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, texts, held = [], [], [], 0
            for doc, t, text in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(doc)
                keys.append(t)
                texts.append(text)
                held += len(text)
                if held > size:
                    yield _hashed(docs, keys, texts, least, min_words)
                    docs, keys, texts, held = [], [], [], 0
            if docs:
                yield _hashed(docs, keys, texts, least, min_words)

    return run


def masks(seed: int = 11) -> list[int]:
    """Masks of 128 bits, one for each block, whatever the number of lines."""
    number = math.ceil(math.log(MISSED) / math.log1p(-(0.9**WIDTH)))
    rng = np.random.default_rng(seed)
    out: list[int] = []
    while len(out) < number:
        order = rng.permutation(128).tolist()
        out += [sum(1 << x for x in order[i : i + WIDTH]) for i in range(0, 128 - WIDTH + 1, WIDTH)]
    return out[:number]


def _spread(chosen: list[int], shares: int, start: int = 0):
    """Each hash under each of the chosen masks, the first of which is number ``start`` of all."""
    low = np.array([m & (1 << 64) - 1 for m in chosen], np.uint64)
    high = np.array([m >> 64 for m in chosen], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sims, rests, ids = [], [], [], []
            for kind, (x, y) in enumerate((("s", "z"), ("g", "h"))):
                here = batch.filter(batch.column(x).is_valid())
                one, two, a = (np.array(here.column(c), np.int64).view(np.uint64) for c in (x, y, "a"))
                sent = one & ~np.uint64(255) | np.array(here.column("length"), np.uint64)
                for i in range(len(low)):
                    keys.append(mixed(mixed(one & low[i]) + (two & high[i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * (start + i) + kind)))
                    sims.append(sent)
                    rests.append(two.astype(np.uint32))
                    ids.append(a)
            key, sim, more, a = np.concatenate(keys), np.concatenate(sims), np.concatenate(rests), np.concatenate(ids)
            share = (key >> np.uint64(32)) % np.uint64(shares)
            order = np.argsort(share.astype(np.int32), kind="stable")
            key, sim, more, a = key[order].astype(np.uint32), sim[order], more[order], a[order]
            used, first = np.unique(share[order], return_index=True)
            ends = np.append(first[1:], len(key))
            parts = [[x[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)] for x in (key, sim, more, a)]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(x, pa.binary()) for x in parts)], names=["share", "key", "sim", "more", "a"])

    return run


def _rows(pairs: list[tuple[np.ndarray, np.ndarray]], members: list[tuple[np.ndarray, ...]]) -> pa.Table:
    none = np.empty(0, np.int64)
    u, v = (np.concatenate([none, *(p[i] for p in pairs)]).astype(np.int64) for i in (0, 1))
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = (u != v) & np.concatenate([np.ones(min(1, len(u)), bool), (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    u, v = u[first], v[first]
    group, a, sim, more = (np.concatenate([none, *(m[i] for m in members)]).astype(np.int64) for i in range(4))
    empty = np.zeros(len(u), np.int64)
    columns = np.repeat([0, 1], [len(u), len(a)]), np.concatenate([u, group]), np.concatenate([v, a]), np.concatenate([empty, sim]), np.concatenate([empty, more])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in _MET.split(", ")])


def _meet(similarity: float):
    return lambda table: _met(table, similarity)


def _met(table: pa.Table, similarity: float) -> pa.Table:
    """Candidates of one share of the groups.

    A group in which a member has more than a few gives each member's least
    candidate only, and is given whole for ``_lead``: its pairs do not grow
    with the square of its size.
    """
    key, sim, more, line = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("key", "<u4"), ("sim", "<u8"), ("more", "<u4"), ("a", "<i8")))
    share = np.int64(table.column("share")[0].as_py())
    # by length within a group, so that a line is compared to those of lengths near its own only; lengths of two groups are never near
    place = key.astype(np.uint64) << np.uint64(9) | sim & np.uint64(255)
    if len(key) < 1 << 23:
        place = np.sort(place << np.uint64(23) | np.arange(len(key), dtype=np.uint64))
        order, place = (place & np.uint64((1 << 23) - 1)).astype(np.int32), (place >> np.uint64(23)).astype(np.int64)
    else:
        order = np.argsort(place)
        place = place[order].astype(np.int64)
    sim, more, line = sim[order], more[order], line[order]
    far = _apart(similarity)
    ahead = np.zeros(len(place), np.int16)
    one, two, unseen = [np.empty(0, np.int32)], [np.empty(0, np.int32)], np.zeros(len(place) + 1, np.int32)
    at, step = None, 0  # rows whose next row is near in length: all of them are looked at in one piece until few are left
    while True:  # every pair of a group that lengths allow lies at some step
        step += 1
        if at is None:
            near = place[step:] - place[:-step] <= far
            if 4 * np.count_nonzero(near) > len(place):
                hit = np.flatnonzero(near & _candidates(sim[step:], sim[:-step]))
            else:
                at = np.flatnonzero(near)
        if at is not None:
            at = at[at + step < len(place)]
            at = at[place[at + step] - place[at] <= far]
            if not len(at):
                break
            hit = at[_candidates(sim[at], sim[at + step])]
        hit = hit[_sure(sim, more, hit, hit + step, similarity)]
        one.append(hit.astype(np.int32))
        two.append((hit + step).astype(np.int32))
        ahead[hit] += 1
        full = hit[ahead[hit] == _CROWD]
        if len(full):  # what they have not seen goes to the group's leaders
            np.add.at(unseen, full + step + 1, 1)
            np.add.at(unseen, np.maximum(full + step + 1, np.searchsorted(place, place[full] + far, side="right")), -1)
            at = np.flatnonzero(place[step:] - place[:-step] <= far) if at is None else at
            at = at[ahead[at] < _CROWD]
    u, v = np.concatenate(one), np.concatenate(two)
    degree = np.bincount(u, minlength=len(place)) + np.bincount(v, minlength=len(place))
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(place)), bool), place[1:] >> 9 != place[:-1] >> 9]))
    crowded = np.repeat(np.maximum.reduceat(degree, new) > _FEW, np.diff(np.append(new, len(place))))
    lone = ~crowded[u]
    pairs = [(line[u[lone]], line[v[lone]])]
    u, v = u[~lone], v[~lone]
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, u, line[v])
    np.minimum.at(least, v, line[u])
    hooked = np.flatnonzero(crowded & (degree > 0))
    pairs.append((line[hooked], least[hooked]))
    rows = np.flatnonzero(crowded & ((degree > 0) | (np.cumsum(unseen[:-1]) > 0)))
    return _rows(pairs, [(share << 32 | place[rows] >> 9, line[rows], sim[rows].view(np.int64), more[rows])])


def _lead(leaders: int, similarity: float):
    """Candidates of up to so many leaders of each group outside their component, and the members that have yet to lead."""

    def run(table: pa.Table) -> pa.Table:
        group, line, sim, more, label = (np.array(table.column(c)) for c in ("x", "y", "z", "more", "label"))
        order = np.lexsort((label, group))
        same_group = np.diff(group[order]) == 0
        runs = np.flatnonzero(np.concatenate([[True], ~same_group | (np.diff(label[order]) != 0)]))  # of one group and component
        sizes = np.diff(np.append(runs, len(group)))
        groups = np.flatnonzero(np.concatenate([[True], ~same_group])[runs])
        many = np.diff(np.append(groups, len(runs)))
        most = np.repeat(np.maximum.reduceat(sizes, groups), many) == sizes
        first = np.cumsum(most) - np.repeat((np.cumsum(most) - most)[groups], many) == 1  # of several largest ones the first
        largest = np.repeat(most & first, sizes)
        parted = np.repeat(np.repeat(many > 1, many), sizes)  # groups of one component are done
        # those outside the largest component lead, and one line leads in all its groups at once
        largest, order = largest[parted], order[parted]
        turn = np.lexsort((mixed(line[order].view(np.uint64)), largest, group[order]))
        largest, order = largest[turn], order[turn]
        group, line, sim, more, label = group[order], line[order], sim[order].view(np.uint64), more[order].astype(np.uint32), label[order]
        pairs, members = [], []
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(group)][: len(new)], strict=True):
            led, i, end = 0, a, a + int(np.count_nonzero(~largest[a:b]))
            while i < end and led < leaders:
                hit = i + 1 + np.flatnonzero(_candidates(sim[i + 1 : b], sim[i]) & (label[i + 1 : b] != label[i]))
                hit = hit[_sure(sim, more, i, hit, similarity)]
                if len(hit):
                    pairs.append((np.full(len(hit), line[i]), line[hit]))
                    led += 1
                i += 1
            if i < end:
                members.append((group[i:b], line[i:b], sim[i:b].view(np.int64), more[i:b]))
        return _rows(pairs, members)

    return run


def edits(a: str, b: str) -> int:
    """Edit distance of two strings."""
    return by_bits(*trimmed(a, b))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normal forms of the wanted lines of each document."""
    for batch in batches:
        ids, forms, held = [], [], 0
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            own = text.split("\n")
            for w in wanted:
                ids.append(w["a"])
                forms.append(normalised(own[w["line"]]))
                held += len(forms[-1])
            if held > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], names=["a", "form"])
                ids, forms, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], names=["a", "form"])


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = pa.array(all_within(x, y, [int((1 - similarity) * max(len(a), len(b))) for a, b in zip(x, y, strict=True)]), pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(good), v.filter(good)], names=["u", "v"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, gone, sums = [], [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed_lines__").to_pylist(), strict=True):
            own = [] if text is None else text.split("\n")
            out = set(removed or ())
            kept = [x for i, x in enumerate(own) if i not in out]
            texts.append(None if text is None else "\n".join(kept))
            lines.append(len(own))
            gone.append(len(own) - len(kept))
            sums.append(hashlib.sha256((texts[-1] or "").encode("utf-8", "surrogatepass")).hexdigest())
        names = [n for n in batch.schema.names if n != "removed_lines__"]
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=[*names, "n_lines_", "n_removed_", "kept_sha256_"])


def repeated_lines(docs: DataFrame, similarity: float = 0.85, min_words: int = 3, short: bool = False) -> DataFrame:
    """doc_id, t, lines: for each document (doc_id and hash of its text) the numbers of the lines to remove."""
    keyed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    found = stored(keyed.mapInArrow(_occurrences(min_words, 1 if short else min_words), _OCCURRENCES), "occurrences")
    place = F.struct("doc_id", "t", "line")
    hashes = [F.first(x).alias(x) for x in ("length", "s", "z", "g", "h")]  # equal forms have equal hashes
    lines = stored(found.groupBy("a", "b").agg(F.min(place).alias("first"), *hashes, F.count("*").alias("n")), "lines")
    number = lines.count()
    chosen = masks()
    each = max(ROUND, min(len(chosen), ENTRIES // max(1, number)))
    shares = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), number * each // 1_000_000)
    hashed = lines.filter("s IS NOT NULL OR g IS NOT NULL").select("a", "length", "s", "z", "g", "h")
    rounds = []
    for first in range(0, len(chosen), each):
        met = hashed.mapInArrow(_spread(chosen[first : first + each], shares, first), "share int, key binary, sim binary, more binary, a binary").groupBy("share").applyInArrow(_meet(similarity), _MET)
        rounds.append(stored(met, "met"))
        del met
        forget(docs.sparkSession)
    met = reduce(DataFrame.unionByName, rounds)
    members = met.filter("kind = 1").select("x", "y", "z", "more")
    pairs = stored(met.filter("kind = 0").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "pairs")
    ends = stored(pairs.select(F.col("u").alias("a")).unionByName(pairs.select(F.col("v").alias("a"))).unionByName(members.select(F.col("y").alias("a"))).distinct().hint("shuffle_hash").join(lines.select("a", "first"), "a"), "ends")
    wanted = ends.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t")).agg(F.collect_list(F.struct("a", F.col("first.line").alias("line"))).alias("wanted"))
    wanted = stored(wanted, "wanted")
    few = wanted.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8 and ends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = keyed.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["doc_id", "t"]).select("text", "wanted").mapInArrow(_forms, "a long, form string")
    own = stored(own.dropDuplicates(["a"]), "forms")
    discard(ends, wanted)

    def links(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(own.select(F.col("a").alias("u"), F.col("form").alias("x")), "u").join(own.select(F.col("a").alias("v"), F.col("form").alias("y")), "v")
        return stored(sides.select("u", "v", "x", "y").mapInArrow(_verify(similarity), "u long, v long"), "links")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs that no link connects yet, with their components."""
        one, two = (labels.select(F.col("v").alias(x), F.col("label").alias(f"label_{x}")) for x in ("u", "v"))
        named = pairs.join(one, "u", "left").join(two, "v", "left").select("u", "v", F.coalesce("label_u", "u").alias("p"), F.coalesce("label_v", "v").alias("q"))
        return stored(named.filter("p <> q").select("u", "v", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")), "apart")

    # each line against its least candidate first, then one pair of each two components: what those connect needs no other verification
    labels = components(links(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")))
    left = apart(pairs, labels)
    labels = components(labels.select(F.col("label").alias("u"), "v").unionByName(links(left.groupBy("p", "q").agg(F.min("u").alias("u"), F.min_by("v", "u").alias("v")).select("u", "v"))))
    left = apart(left.select("u", "v"), labels)
    labels = components(labels.select(F.col("label").alias("u"), "v").unionByName(links(left.select("u", "v"))))
    leaders = 4
    while not members.isEmpty():
        named = stored(members.join(labels.withColumnRenamed("v", "y"), "y", "left").select("x", "y", "z", "more", F.coalesce("label", "y").alias("label")), "members")
        met = stored(named.withColumn("share", F.pmod(F.xxhash64("x"), F.lit(shares)).cast("int")).groupBy("share").applyInArrow(_lead(leaders, similarity), _MET), "met")
        members = met.filter("kind = 1").select("x", "y", "z", "more")
        more = links(met.filter("kind = 0").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        labels = components(labels.select(F.col("label").alias("u"), "v").unionByName(more))
        leaders *= 16
    # the first occurrence of every group that has more than one
    named = lines.join(labels.withColumnRenamed("v", "a").hint("shuffle_hash"), "a", "left").select("a", "b", "first", "n", "label")
    fuzzy = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("keep"))
    many = named.filter("label IS NULL AND n > 1").select("a", "b", F.col("first").alias("keep")).unionByName(named.filter("label IS NOT NULL").join(fuzzy, "label").select("a", "b", "keep"))
    gone = found.join(many.hint("shuffle_hash"), ["a", "b"]).filter(place != F.col("keep"))
    return gone.groupBy("doc_id", "t").agg(F.collect_set("line").alias("lines"))


def without_repeats(docs: DataFrame, similarity: float = 0.85, min_words: int = 3, short: bool = False) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and n_lines_, n_removed_, kept_sha256_.

    Input columns of these three names give way to the results.
    """
    removed = stored(repeated_lines(docs, similarity, min_words, short), "removed")
    names = [c for c in docs.columns if c not in ("n_lines_", "n_removed_", "kept_sha256_")]
    # the row travels as one struct, so that no input column meets a name of the join
    plain = plain_names(names)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain, strict=True)]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    joined = rows.join(removed, ["doc_id", "t"], "left").select("row.*", F.col("lines").alias("removed_lines__"))
    out = T.StructType([T.StructField(p, docs.schema[c].dataType) for c, p in zip(names, plain, strict=True)])
    out = out.add("n_lines_", "long").add("n_removed_", "long").add("kept_sha256_", "string")
    return joined.mapInArrow(_cut, out).toDF(*names, "n_lines_", "n_removed_", "kept_sha256_")
