"""Deep-shallow suffix sorting to a fixed depth, vectorised over all groups of a level."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort sorts by; blind tries order what is still equal.
SHALLOW = 16


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that sorts as they do; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    return out


def _first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of the common prefix of the suffixes at ``a`` and ``b`` (at most ``depth``), and the next byte of each."""
    lcp = np.full(len(a), depth, np.int64)
    own, other = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for at in range(SHALLOW, depth, 8):
        x, y = words[a[open_] + at], words[b[open_] + at]
        if depth - at < 8:
            cut = np.uint64(64 - 8 * (depth - at))
            x, y = x >> cut << cut, y >> cut << cut
        unlike = x != y
        hit = open_[unlike]
        x, y = x[unlike], y[unlike]
        differ = x ^ y
        same = np.zeros(len(hit), np.int64)
        for k in range(1, 8):
            same += differ >> np.uint64(64 - 8 * k) == 0
        shift = (56 - 8 * same).astype(np.uint64)
        lcp[hit] = at + same
        own[hit] = (x >> shift & np.uint64(255)).astype(np.int64)
        other[hit] = (y >> shift & np.uint64(255)).astype(np.int64)
        open_ = open_[~unlike]
        if not len(open_):
            break
    return lcp, own, other


def sort_suffixes(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and where in that order a new prefix begins.

    ``words`` (big_endian_words) must reach ``depth`` bytes beyond each start.
    """
    # Shallow: multikey quicksort with characters of eight bytes; groups of equal prefixes are split by the next one.
    order = np.argsort(words[starts])
    fresh = np.diff(words[starts[order]], prepend=np.uint64(0)) != 0
    if len(fresh):
        fresh[0] = True
    for at in range(8, SHALLOW, 8):
        slots, group = _unsettled(fresh)
        if not len(slots):
            return order, fresh
        own = order[slots]
        chars = words[starts[own] + at]
        by = np.lexsort((chars, group))
        order[slots] = own[by]
        chars = chars[by]
        fresh[slots[1:]] |= (chars[1:] != chars[:-1]) & (group[1:] == group[:-1])
    # Deep: a blind trie for each group that still has a common prefix. Its first suffix is the path along which the
    # others are compared; they branch off by side, depth and byte into subtries, which are built alike.
    slots, group = _unsettled(fresh)
    while len(slots):
        head = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(head, len(slots)))
        own = order[slots]
        lcp, byte, other = _first_difference(words, starts[own], starts[np.repeat(own[head], size)], depth)
        equal = lcp == depth
        branch = np.where(equal, depth, np.where(byte < other, lcp, 2 * depth + 1 - lcp))
        key = np.repeat(np.arange(len(head)), size) << 16 | branch << 8 | np.where(equal, 0, byte)
        by = np.argsort(key)
        order[slots] = own[by]
        key, equal = key[by], equal[by]
        fresh[slots[1:]] |= key[1:] != key[:-1]
        left = ~equal
        slots, key = slots[left], key[left]
        if not len(slots):
            break
        group = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        many = np.bincount(group)[group] > 1
        slots, group = slots[many], group[many]
    return order, fresh


def _unsettled(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots in groups of two or more, and the group of each."""
    group = np.cumsum(fresh) - 1
    slots = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.empty(0, np.int64)
    return slots, group[slots]
