"""Suffix arrays and common prefixes in numpy, for texts of a few megabytes."""

from __future__ import annotations

import numpy as np

LANE = 256


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a big-endian number, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes or more, and the eight-byte words.

    Larsson-Sadakane refinement: suffixes sorted by h bytes are sorted by 2h by the
    rank of what follows h bytes on; groups of one are done and leave the work. The
    first round sorts by eight bytes at once. Behind the end of the text there are
    zeros; suffixes that only differ there stay in order of position.
    """
    n = len(text)
    words = words_at(text)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(words[order]) != 0])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    open_ = np.repeat(sizes > 1, sizes)
    places = np.flatnonzero(open_)  # positions of the order that belong to groups of two or more
    h = 8
    while h < depth and len(places):
        suffixes = order[places]
        group = rank[suffixes]
        following = suffixes + h
        behind = np.where(following < n, rank[np.minimum(following, n - 1)] + 1, 0)
        key = group * (n + 1) + behind
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[places] = suffixes
        first = np.concatenate([[True], np.diff(key) != 0])
        begins = np.flatnonzero(first)
        sizes = np.diff(np.append(begins, len(key)))
        rank[suffixes] = np.repeat(places[begins], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order, words


def common_prefixes(order: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """LCP of each suffix in the order with the one before it, up to ``limit``.

    Kasai's walk in text order: the prefix shared at i + 1 is at least one shorter
    than at i. Stretches of ``LANE`` positions are walked side by side, so each step
    is a vector operation, and eight bytes are compared at a time.
    """
    n = len(order)
    if not n:
        return np.empty(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    lanes = np.arange(0, n, LANE)
    h = np.zeros(len(lanes), np.int64)
    for step in range(min(LANE, n)):
        i = lanes + step
        if i[-1] >= n:
            lanes, i, h = lanes[:-1], i[:-1], h[:-1]
        k = before[i]
        known = (h < limit) | (k == before[i - 1] + 1) if step else np.zeros(len(i), bool)
        h = np.where((k < 0) | ~known, 0, np.maximum(h - 1, 0))
        todo = np.flatnonzero(k >= 0)
        while len(todo):
            a, b = i[todo] + h[todo], k[todo] + h[todo]
            inside = (a < n) & (b < n) & (h[todo] < limit)
            todo, a, b = todo[inside], a[inside], b[inside]
            differs = words[a] ^ words[b]
            # bytes before the first difference: leading zero bytes of the big-endian word
            same = np.where(differs == 0, 8, _leading_zero_bits(differs) // 8)
            room = np.minimum(n - a, n - b)
            gained = np.minimum(same, room)
            h[todo] += gained
            todo = todo[gained == 8]
        shared[i] = np.minimum(h, limit)
        h = np.minimum(h, limit)
    return shared[order]


def _leading_zero_bits(x: np.ndarray) -> np.ndarray:
    """Leading zeros of nonzero 64-bit numbers."""
    y = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        y |= y >> np.uint64(s)
    return 64 - np.bitwise_count(y).astype(np.int64)


def repeated_classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Class number of each text position: equal for positions whose first ``length`` bytes are equal."""
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(shared < length)
    return numbers
