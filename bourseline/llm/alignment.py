"""Edit distance of two sequences, by bits and by bands of diagonals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np

#: Diagonals on either side that are followed one by one; beyond them the whole table is computed by bits.
NARROW = 24
#: Words left out on either side, the fewest first.
_STEPS = [(d, t - d) for t in range(1, 7) for d in range(t + 1)]


def _shared(a: Sequence, b: Sequence) -> int:
    """Length of the common beginning, by halves."""
    n, m = 0, min(len(a), len(b))
    while n < m:  # the beginning of n is common, that of m + 1 is not
        k = (n + m + 1) // 2
        n, m = (k, m) if a[n:k] == b[n:k] else (n, k - 1)
    return n


def trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both without what they begin and end with in common, which costs no edit."""
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    n = _shared(a[::-1], b[::-1])
    return (a[:-n], b[:-n]) if n else (a, b)


def by_bits(a: Sequence, b: Sequence) -> int:
    """Edit distance, a column of the table at a time as the bits of an integer."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(across | up)) & full, up & across
        score += 1 if rise & top else -1 if fall & top else 0
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up, down = (fall | ~(same | down | rise)) & full, rise & (same | down)
    return score


def by_diagonals(a: Sequence, b: Sequence, limit: int) -> int | None:
    """Edit distance, None if it is over ``limit``: the furthest points on the band of diagonals that so many edits reach."""
    m, n = len(a), len(b)
    far = {0: _shared(a, b)}
    for e in range(limit + 1):
        if e:
            now = {}
            for k in range(-e, e + 1):
                i = max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
                i = min(i, m, n - k)
                if i < 0 or i + k < 0:
                    continue
                while i < m and i + k < n and a[i] == b[i + k]:
                    i += 1
                now[k] = i
            far = now
        if far.get(n - m, -1) >= m:
            return e
    return None


def edits_within(a: Sequence, b: Sequence, limit: int) -> int | None:
    """Edit distance of two sequences, None if it is over ``limit``.

    What they lack of each other's elements is a lower bound; few edits are
    followed by diagonals, many by bits, so that neither length nor edits make
    it quadratic in Python steps.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    if max(len(a), len(b)) > limit:
        more = Counter(a)
        more.subtract(b)
        if max(sum(n for n in more.values() if n > 0), -sum(n for n in more.values() if n < 0)) > limit:
            return None
    found = by_diagonals(a, b, min(limit, NARROW))
    if found is None and limit > NARROW:
        found = by_bits(a, b)
    return found if found is not None and found <= limit else None


def by_words(p: list[str], q: list[str], limit: int) -> bool:
    """Whether one way from words to words costs at most ``limit`` characters: words pass until they differ, then go on at the nearest equal ones."""
    i = j = cost = 0
    m, n = len(p), len(q)
    while i < m and j < n:
        if p[i] == q[j]:
            i += 1
            j += 1
            continue
        for d, e in _STEPS:
            if i + d < m and j + e < n and p[i + d] == q[j + e]:
                break
        else:
            break
        cost += max(sum(map(len, p[i : i + d])) + d, sum(map(len, q[j : j + e])) + e)
        if cost > limit:
            return False
        i += d
        j += e
    return cost + max(sum(map(len, p[i:])) + m - i, sum(map(len, q[j:])) + n - j) <= limit


def texts_within(a: str, b: str, limit: int) -> bool:
    """Whether two lines of words are at most ``limit`` characters' edits apart; most are decided word by word."""
    sure = _by_pieces(a, b, limit)
    return by_bits(*trimmed(a, b)) <= limit if sure is None else sure


def _by_pieces(a: str, b: str, limit: int) -> bool | None:
    """What lengths and words tell of ``texts_within``; None if they leave it open."""
    if abs(len(a) - len(b)) > limit:
        return False
    a, b = trimmed(a, b)
    if max(len(a), len(b)) <= limit:
        return True
    p, q = a.split(" "), b.split(" ")
    if len(p) == len(q) and sum(max(len(x), len(y)) for x, y in zip(p, q, strict=True) if x != y) <= limit:
        return True  # words changed one for one
    return True if by_words(p, q, limit) else None


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters, and where each text begins and how long it is."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum(sizes) - sizes, sizes


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _triples_differ(xs: list[str], ys: list[str], limits: np.ndarray) -> np.ndarray:
    """Texts with more different triples of letters than so many edits explain: an edit changes three on either side."""
    longest = max(map(len, xs + ys))
    bins = 1 << max(8, (4 * longest).bit_length())
    counts = np.zeros(len(xs) * bins, np.int64)
    for texts, sign in ((xs, 1), (ys, -1)):
        letters, starts, sizes = _letters(texts)
        sizes = np.maximum(sizes - 2, 0)
        at, own = _runs(starts, sizes), np.repeat(np.arange(len(texts)), sizes)
        codes = letters[at].astype(np.uint64) | letters[at + 1].astype(np.uint64) << np.uint64(21) | letters[at + 2].astype(np.uint64) << np.uint64(42)
        hashed = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - bins.bit_length())).astype(np.int64)
        counts += sign * np.bincount(own * bins + hashed, minlength=len(counts))
    return np.abs(counts).reshape(len(xs), bins).sum(axis=1) > 6 * limits


def _edits_of_all(xs: list[str], ys: list[str], limit: int) -> np.ndarray:
    """Edit distances of pairs whose first texts are equally long, none of them empty; those over ``limit`` may come out too high.

    As ``by_bits`` does, but for all pairs at once and for words near the diagonal only.
    """
    letters, begin, m = _letters(xs)
    other, start, n = _letters(ys)
    kinds = np.unique(letters)
    place = np.minimum(np.searchsorted(kinds, other), len(kinds) - 1)
    place = np.where(kinds[place] == other, place, len(kinds))
    number, words, one = len(xs), int(m.max() + 63) // 64, np.uint64(1)
    same = np.zeros((words, (len(kinds) + 1) * number), np.uint64)  # one row of pairs for each kind of letter
    at = np.repeat(np.arange(number), m)
    inner = _runs(np.zeros(number, np.int64), m)
    np.bitwise_or.at(same, (inner >> 6, np.searchsorted(kinds, letters) * number + at), one << (inner & 63).astype(np.uint64))
    up, down = np.full((words, number), ~np.uint64(0)), np.zeros((words, number), np.uint64)
    top = ((m - 1) & 63).astype(np.uint64)
    pairs, last = np.arange(number), min(words - 1, limit // 64)
    score = np.minimum(m, 64 * (last + 1))
    out = np.full(number, limit + 1)
    high = np.full(number, np.uint64(63))
    for j in range(int(n.max())):
        if last < words - 1 and 64 * (last + 1) <= j + limit:
            last += 1
            score = score + np.minimum(m, 64 * (last + 1)) - 64 * last
        here = place[np.minimum(start + j, len(place) - 1)] * number + pairs
        rising, falling = one, np.uint64(0)  # what the row above adds
        for w in range(max(0, (j - limit) // 64), last + 1):
            u, d, eq = up[w], down[w], same[w][here]
            level = eq | d
            eq |= falling
            across = (((eq & u) + u) ^ u) | eq
            rise, fall = d | ~(across | u), u & across
            bit = top if w == words - 1 else high
            next_rising, next_falling = rise >> bit & one, fall >> bit & one
            rise, fall = rise << one | rising, fall << one | falling
            up[w], down[w] = fall | ~(level | rise), rise & level
            rising, falling = next_rising, next_falling
        score = score + rising.astype(np.int64) - falling.astype(np.int64)
        if last == words - 1:
            done = n == j + 1
            out[done] = score[done]
    return out


def all_within(xs: list[str], ys: list[str], limits: list[int], few: int = 12) -> np.ndarray:
    """``texts_within`` for many pairs: what words and different triples leave open is computed together, but for ``few`` pairs."""
    sure = [_by_pieces(x, y, k) for x, y, k in zip(xs, ys, limits, strict=True)]
    good = np.array([x is True for x in sure], bool)
    left = sorted((len(xs[k]), k) for k, known in enumerate(sure) if known is None)
    open_: list[tuple[int, int, str, str]] = []
    while left:
        size = max(1, min(256, (1 << 17) // max(64, left[min(255, len(left) - 1)][0])))
        part, left = [k for _, k in left[:size]], left[size:]
        differ = _triples_differ([xs[k] for k in part], [ys[k] for k in part], np.array([limits[k] for k in part]))
        for k in (k for k, no in zip(part, differ.tolist(), strict=True) if not no):
            a, b = trimmed(xs[k], ys[k])
            open_.append((len(a), k, a, b))
    open_.sort()
    while open_:
        # like lengths, brought to one length by a beginning that both texts share
        size, least = 1, open_[0][0]
        while size < min(1024, len(open_)) and open_[size][0] <= (1.25 if size >= 256 else 1.6) * least + 64:
            size += 1
        part, open_ = open_[:size], open_[size:]
        limit, full = max(limits[k] for _, k, _, _ in part), (part[-1][0] + 63) // 64 * 64
        if size >= few * min(full // 64, 2 + limit // 32):
            found = _edits_of_all(["\0" * (full - n) + a for n, _, a, _ in part], ["\0" * (full - n) + b for n, _, _, b in part], limit).tolist()
        else:
            found = [by_bits(a, b) for _, _, a, b in part]
        for d, (_, k, _, _) in zip(found, part, strict=True):
            good[k] = d <= limits[k]
    return good
