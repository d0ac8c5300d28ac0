"""Word shingles of texts as sets of 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from chunkloom.llm.common import grouped_by_bytes, mix64, rolling_hash

WORDS = 5
#: Bytes of text that are hashed at once.
BLOCK = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    gap = _SEPARATOR[raw]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    rolling = rolling_hash()
    hashes = rolling.ranges(rolling.prefix(raw), start, end)
    return start, mix64(hashes ^ (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _long_text_words(text: bytes) -> np.ndarray:
    """Word hashes of one long text, block by block: blocks end at a separator."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not _SEPARATOR[text[end]]:
            end += 1
        out.append(_word_hashes(text[at:end])[1])
        at = end
    return np.concatenate(out)


def _shingles(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) and how many each text has. ``first``: a text's first word."""
    n = len(words)
    sums = np.zeros(n, np.uint64)
    for k in range(min(WORDS, n)):
        part = mix64(words[k:] + np.uint64(0xA0761D6478BD642F * (k + 1) % (1 << 64)))
        sums[: n - k] += part
    short = np.flatnonzero((count < WORDS) & (count > 0))
    for i in short:  # a text of fewer words is one shingle, its hash marked by their number
        s = words[first[i] : first[i] + count[i]]
        sums[first[i]] = sum(int(mix64(s[k : k + 1] + np.uint64(0xA0761D6478BD642F * (k + 1) % (1 << 64)))[0]) for k in range(len(s))) % (1 << 64) ^ len(s)
    n_shingles = np.where(count == 0, 0, np.maximum(count - WORDS + 1, 1))
    total = int(n_shingles.sum())
    offset = np.repeat(first - (np.cumsum(n_shingles) - n_shingles), n_shingles)
    return mix64(sums[np.arange(total) + offset]), n_shingles


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, sorted distinct hashes of a run of texts, set sizes), run after run.

    Words are what stands between the characters 0x20 and 0x09 to 0x0D, with A-Z lower-cased. A text's set
    holds its distinct shingles of five words; with fewer words, the whole sequence as one.
    """
    for part in grouped_by_bytes(texts, BLOCK):
        group = [t.lower() for t in texts[part]]
        if len(group) == 1 and len(group[0]) > BLOCK:
            words = _long_text_words(group[0])
            first, count = np.zeros(1, np.int64), np.array([len(words)])
        else:
            start, words = _word_hashes(b" ".join(group))
            ends = np.cumsum([len(t) + 1 for t in group])
            last = np.searchsorted(start, ends)
            first = np.concatenate([[0], last[:-1]])
            count = last - first
        hashes, sizes = _shingles(words, first, count)
        out, distinct, at = [], np.zeros(len(group), np.int64), 0
        for i, n in enumerate(sizes.tolist()):
            if n:
                own = np.sort(hashes[at : at + n])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                distinct[i] = len(own)
                out.append(own)
                at += n
        yield part.start, np.concatenate(out) if out else np.empty(0, np.uint64), distinct
