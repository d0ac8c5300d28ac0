"""Greedy packing of segment lengths into chunk spans.

The packing is the one step of chunking that is sequential inside a document. It needs
only lengths, so texts stay in the JVM and just small integer arrays cross to Python. A
chunk's end is found by bisection over running ends: the work is one prefix sum per
document plus a few steps per chunk, not a step per segment.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# The packers are called non-deterministic so that a filter on chunks is never pushed below
# them: that would split and pack every text twice.
SPANS = "array<struct<start:int,len:int>>"


def _pack_run(starts, ends, size, overlap, out):
    """Spans of one run of segments that are joined by single spaces."""
    n, first, begin = len(ends), 0, starts[0]
    while True:
        stop = max(bisect_right(ends, size + 1 + begin), first + 1)
        end = ends[stop - 1]
        out.append((begin, end - begin))
        if stop >= n:
            return
        first = stop
        begin = end - overlap if 0 < overlap < end - begin else starts[stop]


def _window_cuts(word_lens, offset, size, overlap, out):
    """Windows over one over-long segment, cut at the last space past half a window."""
    ends = np.cumsum(np.asarray(word_lens, dtype=np.int64) + 1) - 1
    total, gaps, i = int(ends[-1]), ends[:-1].tolist(), 0
    while total - i > size:
        cut = i + size
        at = bisect_left(gaps, cut) - 1
        if at >= 0 and gaps[at] > i + size // 2:
            cut = gaps[at]
        out.append((offset + i, cut - i))
        i = max(i + 1, cut - overlap)
    out.append((offset + i, total - i))


def pack_chars(lens, long_words, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans for segments joined by a space.

    ``long_words`` holds the word lengths of each segment above ``size`` that must be cut
    by windows, in order; empty when over-long segments are packed like any other.
    """
    if not len(lens):
        return []
    lens = np.asarray(lens, dtype=np.int64)
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    out: list[tuple[int, int]] = []
    barriers = np.flatnonzero(lens > size).tolist() if len(long_words) else []
    starts, ends, at = starts.tolist(), ends.tolist(), 0
    for words, b in zip(long_words, barriers):
        if b > at:
            _pack_run(starts[at:b], ends[at:b], size, overlap, out)
        _window_cuts(words, starts[b], size, overlap, out)
        at = b + 1
    if at < len(ends):
        _pack_run(starts[at:], ends[at:], size, overlap, out)
    return out


def pack_sentences(lens, size: int, keep: int) -> list[tuple[int, int]]:
    """Spans for sentences joined without a separator; ``keep`` sentences are repeated."""
    n = len(lens)
    if not n:
        return []
    edge = [0, *np.cumsum(np.asarray(lens, dtype=np.int64)).tolist()]
    out, head, first = [], 0, 0
    while True:
        stop = max(bisect_right(edge, edge[head] + size) - 1, first + 1)
        out.append((edge[head], edge[stop] - edge[head]))
        if stop >= n:
            return out
        head, first = max(head, stop - keep), stop


def _rows(column: pa.ListArray):
    """The values of each list of an Arrow column, without making Python objects."""
    values = column.flatten()
    edges = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
    if isinstance(values, pa.ListArray):
        inner = list(_rows(values))
        return (inner[a:b] for a, b in zip(edges[:-1], edges[1:]))
    flat = values.to_numpy()
    return (flat[a:b] for a, b in zip(edges[:-1], edges[1:]))


def _to_arrow(rows: list[list[tuple[int, int]]]) -> pa.ListArray:
    counts = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    flat = np.array([s for r in rows for s in r], dtype=np.int32).reshape(-1, 2)
    struct = pa.StructArray.from_arrays(
        [pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "len"]
    )
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), struct)


def char_packer(size: int, overlap: int) -> Callable:
    @F.arrow_udf(SPANS)
    def spans(lens: pa.Array, long_words: pa.Array) -> pa.Array:
        return _to_arrow(
            [pack_chars(a, w, size, overlap) for a, w in zip(_rows(lens), _rows(long_words))]
        )

    return spans.asNondeterministic()


def sentence_packer(size: int, keep: int) -> Callable:
    @F.arrow_udf(SPANS)
    def spans(lens: pa.Array) -> pa.Array:
        return _to_arrow([pack_sentences(a, size, keep) for a in _rows(lens)])

    return spans.asNondeterministic()


def topic_breaks(sizes: list[int], buckets: np.ndarray, dim: int, percent: int) -> np.ndarray:
    """Whether neighbouring sentences part: their bags' cosine lies below the ``percent``-th percentile (a value that occurs) of
    all neighbours of the text. ``sizes``: tokens of each sentence, ``buckets``: the bucket of each token."""
    n = len(sizes)
    if n < 2:
        return np.zeros(0, bool)
    place = np.repeat(np.arange(n), sizes) * dim + buckets
    where, counts = np.unique(place, return_counts=True)
    norms = np.bincount(where // dim, (counts * counts).astype(np.float64), n)
    # a bucket of a sentence meets the same bucket of the next one
    at = np.searchsorted(where, where + dim)
    met = (at < len(where)) & (where[np.minimum(at, len(where) - 1)] == where + dim) if len(where) else np.zeros(0, bool)
    dots = np.bincount(where[met] // dim, (counts[met] * counts[at[met]]).astype(np.float64), n)[: n - 1]
    size = np.sqrt(norms[:-1] * norms[1:])
    cosines = np.divide(dots, size, out=np.zeros(n - 1), where=size > 0)
    return cosines < np.sort(cosines)[-(-(n - 1) * percent // 100) - 1]


def pack_topics(lens, breaks, size: int) -> list[tuple[int, int]]:
    """(first sentence, sentences) of each chunk: sentences joined by spaces up to ``size`` characters, parted at breaks."""
    out, first, length = [], 0, 0
    for i, n in enumerate(lens):
        if i > first and (breaks[i - 1] or length + 1 + n > size):
            out.append((first, i - first))
            first, length = i, n
        else:
            length += n + (i > first)
    return [*out, (first, len(lens) - first)] if len(lens) else out


def topic_packer(size: int, dim: int, percent: int) -> Callable:
    @F.arrow_udf(SPANS)
    def spans(lens: pa.Array, buckets: pa.Array) -> pa.Array:
        out = []
        for own, tokens in zip(_rows(lens), buckets, strict=True):
            inner = tokens.values
            sizes = inner.value_lengths().to_pylist() if inner is not None else []
            flat = inner.flatten().to_numpy(zero_copy_only=False) if inner is not None else np.zeros(0, np.int64)
            out.append(pack_topics(np.asarray(own).tolist(), topic_breaks(sizes, flat.astype(np.int64), dim, percent), size))
        return _to_arrow(out)

    return spans.asNondeterministic()
