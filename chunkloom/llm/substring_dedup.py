"""Removal of repeated substrings by sorting the suffixes that can repeat.

A byte goes if it is covered by a string of ``WINDOW`` bytes that also starts in a document with a smaller id. Strings are judged
on the input, matches never cross documents, overlaps count.

1. Documents are dealt into blocks of bounded bytes by a hash of id and text. Copies of a whole text are
   found by digest and leave the search: all their strings occur in the first of them.
2. Each string of ``WINDOW`` bytes has a key: the smallest hash of the ``GRAM``-byte grams in it. Equal strings have equal keys,
   and about 18 neighbouring strings share one. Blocks send their distinct keys by hash; keys that two documents have return to
   their blocks.
3. The stretches of text whose strings have such keys are sent by key. First a digest of each, with the smallest id of the block:
   of equal stretches only those of the smallest id are cut out and sent, the others go as a whole. At the edges of a passage the
   stretches differ from document to document; if a key stands in more than ``HOT_BLOCKS`` blocks, its windows travel one by one,
   dealt by their own bytes: equal ones still meet. Each receiver sorts all suffixes of its stretches (suffix_sort: multikey
   quicksort, then blind tries) and flags those whose prefix of ``WINDOW`` bytes stands also under a smaller id.
4. Flagged spans return to their blocks and are cut out.

Each block's texts are shuffled once; keys, digests and stretches travel as packed numbers of few bytes. Keys are as short as lets
one in some 256 meet another's by chance. A passage in a third of all documents costs a digest for each block and is sent once, its edges
at most ``HOT_BLOCKS`` blocks' stretches in one task. Nothing is sampled: the keys are only a way to bring equal strings together.
Receivers are fewer than blocks in large inputs, as blocks times receivers is the number of messages.

Defined results: null texts are empty; texts shorter than the window lose nothing; rows with a null id neither lose
anything nor cause a loss; rows that repeat an id don't affect each other. Very long texts are worked through in
pieces that overlap by a window. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import bounded_batches, discard, mix64, rolling_hash, utf8, written
from chunkloom.llm.suffix_sort import big_endian_words, sort_suffixes

WINDOW = 50
GRAM = 20
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Up to so many blocks there is a receiver of keys and stretches for each; beyond that, about one for every ``PER_RECEIVER``.
RECEIVERS, PER_RECEIVER = 128, 4
#: Bits of a key beyond those that number all keys.
SPARE_BITS = 8
#: Bytes of text whose windows are hashed at once.
PIECE = 1 << 18
#: A key in more blocks than this is hot: its windows are dealt one by one.
HOT_BLOCKS = 512
#: Suffixes that are sorted at once.
SORT_ROWS = 500_000


def _window_keys(data: np.ndarray) -> np.ndarray:
    """The key of the window at each position of ``data``."""
    rolling = rolling_hash()
    n = len(data) - GRAM + 1
    prefix = rolling.prefix(data)
    low = mix64((prefix[GRAM : GRAM + n] - prefix[:n]) * rolling.inverse[:n])
    span, grams = 1, WINDOW - GRAM + 1
    while span * 2 <= grams:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (grams - span)], low[grams - span :]) if grams > span else low


def _pieces(texts: list[bytes], which: list[int]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts joined: (data, text number, place in data, place in text) of each piece of a text."""
    data, rows, size = [], [], 0
    for i in which:
        t = texts[i]
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1]
            if size and size + len(part) > PIECE + WINDOW:
                yield b"".join(data), *(np.array(x) for x in zip(*rows, strict=True))
                data, rows, size = [], [], 0
            rows.append((i, size, at))
            data.append(part)
            size += len(part)
    if size:
        yield b"".join(data), *(np.array(x) for x in zip(*rows, strict=True))


def _stretches(texts: list[bytes], which: list[int]) -> Iterator[tuple[bytes, np.ndarray, ...]]:
    """For runs of texts: data and, for each stretch of windows with one key, its key, place in data, number of windows,
    text number and place in the text."""
    for data, text, place, at in _pieces(texts, which):
        raw = np.frombuffer(data, np.uint8)
        keys = _window_keys(raw)
        end = np.append(place[1:], len(raw))
        valid = np.zeros(len(keys) + 1, np.int8)
        valid[place] += 1
        valid[end - WINDOW + 1] -= 1  # pieces are at least a window long
        valid = np.cumsum(valid[:-1]).astype(bool)
        change = np.empty(len(keys), bool)
        change[0] = True
        np.not_equal(keys[1:], keys[:-1], out=change[1:])
        change[1:] |= valid[1:] != valid[:-1]
        start = np.flatnonzero(change)
        count = np.diff(np.append(start, len(keys)))
        ok = valid[start]
        start, count = start[ok], count[ok]
        of = np.searchsorted(place, start, "right") - 1
        yield data, keys[start], start, count, text[of], start - place[of] + at[of]


def _arrow(schema: T.StructType, **columns) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.Table.from_pydict(columns, schema=to_arrow_schema(schema))


_KEYS = T.StructType().add("part", T.IntegerType()).add("block", T.IntegerType()).add("payload", T.BinaryType())
#: What a block gets: a copy's doc_id and rid, a receiver's list of shared keys (digests is false) or its answer to the block's digests.
_SHARED = (
    T.StructType().add("block", T.IntegerType()).add("doc_id", T.LongType()).add("rid", T.LongType()).add("part", T.IntegerType())
    .add("digests", T.BooleanType()).add("payload", T.BinaryType())
)
_CUT = T.StructType().add("part", T.IntegerType()).add("block", T.IntegerType()).add("done", T.BooleanType()).add("meta", T.BinaryType()).add("data", T.BinaryType())
_SPANS = T.StructType().add("block", T.IntegerType()).add("doc_id", T.LongType()).add("rid", T.LongType()).add("payload", T.BinaryType())


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, each in as few bytes as its range needs, lowest bytes first."""
    out = [np.uint32(len(columns[0])).tobytes()]
    for x in columns:
        x = np.ascontiguousarray(x).view(np.int64)
        base = x.min() if len(x) else np.int64(0)
        above = x.view(np.uint64) - base.view(np.uint64)
        width = (int(above.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [base.tobytes(), bytes([width]), above.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def _unpacked(payload: bytes, columns: int) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(payload, np.uint32, 1)[0]), 4, []
    for _ in range(columns):
        base, width = np.frombuffer(payload, np.uint64, 1, at), payload[at + 8]
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(payload, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append((x.view(np.uint64).ravel() + base).view(np.int64))
        at += 9 + n * width
    return out


def _marked(numbers: np.ndarray, mark: np.ndarray) -> bytes:
    """Distinct numbers below 2**62 in ascending order, with a mark on some."""
    return _packed(np.diff(numbers.astype(np.int64), prepend=0) << 1 | mark)


def _unmarked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    (steps,) = _unpacked(payload, 1)
    return np.cumsum(steps >> 1), (steps & 1).astype(bool)


def _block(left: pa.Table, right: pa.Table, text: str) -> tuple[list[bytes], np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Texts, ids and rows of a block, the texts to be searched and whether each is a copy. Rows are numbered by id and
    text, equal ones alike, so that their numbers are the same whenever the block is read."""
    texts = utf8(left[text])
    doc = left["__doc"].fill_null(-1).to_numpy()
    rid = left["__rid"].to_numpy()
    copies = set()
    if right.num_rows:
        marked = right.filter(right["rid"].is_valid())
        copies = set(zip(marked["doc_id"].to_pylist(), marked["rid"].to_pylist(), strict=True))
    copy = np.array([x in copies for x in zip(doc.tolist(), rid.tolist(), strict=True)], bool)
    known = left["__doc"].is_valid().to_numpy()
    which = [i for i, t in enumerate(texts) if len(t) >= WINDOW and not copy[i] and known[i]]
    row, order = np.zeros(len(texts), np.int64), np.lexsort((rid, doc))
    row[order] = np.cumsum(_changes(doc[order], rid[order])) - 1
    return texts, doc, row, which, copy


def _block_number(left: pa.Table, right: pa.Table) -> int:
    return (left if left.num_rows else right)["__block" if left.num_rows else "block"][0].as_py()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _runs(first: np.ndarray) -> Iterator[slice]:
    """The runs of rows that begin where ``first`` is true."""
    at = np.flatnonzero(first).tolist()
    return (slice(a, b) for a, b in zip(at, [*at[1:], len(first)], strict=False))


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(key) >> np.uint64(64 - bits)).astype(np.int64)


def _send_keys(text: str, parts: int, bits: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, doc, _, which, _ = _block(left, right, text)
        keys, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, key, _, _, of, _ in _stretches(texts, which):
            keys.append(_short(key, bits))
            docs.append(doc[of])
        key, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key)
        key, docs = key[order], docs[order]
        first = np.flatnonzero(_changes(key))
        several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first) if len(first) else np.empty(0, bool)
        key = key[first]
        part = key % parts
        order = np.argsort(part, kind="stable")
        key, part, several = key[order], part[order], several[order]
        runs = list(_runs(_changes(part)))
        return _arrow(
            _KEYS, part=[int(part[r.start]) for r in runs], block=[_block_number(left, right)] * len(runs),
            payload=[_marked(key[r] // parts, several[r]) for r in runs],
        )

    return send


def _answers(group: pa.Table, digests: bool, payload: list[bytes | None]) -> pa.Table:
    """``payload`` for the blocks of ``group``, where there is one."""
    block = [b for b, x in zip(group["block"].to_pylist(), payload, strict=True) if x is not None]
    none = [None] * len(block)
    return _arrow(
        _SHARED, block=block, doc_id=none, rid=none, part=[group["part"][0].as_py()] * len(block), digests=[digests] * len(block),
        payload=[x for x in payload if x is not None],
    )


def _shared_keys(hot_blocks: int):
    """Of the keys in each block's message, those that two documents have, wherever; with a mark on hot ones."""

    def shared_keys(group: pa.Table) -> pa.Table:
        messages = [_unmarked(x) for x in utf8(group["payload"])]
        plain, blocks = np.unique(np.concatenate([key for key, _ in messages]), return_counts=True)  # a block names a key once
        twice, hot = plain[blocks > 1], plain[blocks > hot_blocks]
        shared = np.union1d(twice, np.concatenate([key[several] for key, several in messages]))
        out = [key[_member(key, shared)] for key, _ in messages]
        return _answers(group, False, [_marked(key, _member(key, hot)) if len(key) else None for key in out])

    return shared_keys


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    if not len(start):
        return data[:0]
    offset = np.repeat(start - (np.cumsum(size) - size), size)
    return data[np.arange(int(size.sum())) + offset]


def _candidates(left: pa.Table, right: pa.Table, text: str, parts: int, bits: int) -> tuple[np.ndarray, ...] | None:
    """The stretches of a block whose keys are shared, hot ones window by window, ordered by (part, content, id): part, content, id, row,
    place in the text, number of windows, 16 bits of a hash that equal windows have in common, place in the data; and the data."""
    texts, doc, row, which, _ = _block(left, right, text)
    lists = right.filter(pa.compute.equal(right["digests"], False))
    shared, hot = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part, payload in zip(lists["part"].to_pylist(), utf8(lists["payload"]), strict=True):
        key, mark = _unmarked(payload)
        shared.append(key * parts + part)
        hot.append(shared[-1][mark])
    shared, hot = np.sort(np.concatenate(shared)), np.sort(np.concatenate(hot))
    found: list[tuple[np.ndarray, ...]] = []
    cut: list[np.ndarray] = []
    rolling, base = rolling_hash(), 0
    for data, key, start, count, of, at in _stretches(texts, which) if len(shared) else ():
        key = _short(key, bits)
        ok = _member(key, shared)
        key, start, count, of, at = key[ok], start[ok], count[ok], of[ok], at[ok]
        single = _member(key, hot)
        if single.any():
            times = np.where(single, count, 1)
            offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            key, start, count, of, at, single = (np.repeat(x, times) for x in (key, start, count, of, at, single))
            start, at, count = start + offset, at + offset, np.where(single, 1, count)
        raw = np.frombuffer(data, np.uint8)
        size = count + WINDOW - 1
        content = mix64(rolling.ranges(rolling.prefix(raw), start, start + size) ^ mix64(size.astype(np.uint64)))
        key = np.where(single, content, key.astype(np.uint64))
        cut.append(_gather(raw, start, size))
        turn = (mix64(key ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype(np.int64)
        found.append(((key % np.uint64(parts)).astype(np.int64), content, doc[of], row[of], at, count, turn, np.cumsum(size) - size + base))
        base += int(size.sum())
    if not base:
        return None
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    return *(x[order] for x in columns), np.concatenate(cut)


def _send_digests(text: str, parts: int, bits: int):
    """To each receiver, the distinct stretches of a block in order of their content: the content's digest and the smallest id."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _candidates(left, right, text, parts, bits)
        if found is None:
            return _arrow(_KEYS, part=[], block=[], payload=[])
        first = np.flatnonzero(_changes(*found[:2]))
        part, content, doc = (x[first] for x in found[:3])
        runs = list(_runs(_changes(part)))
        return _arrow(
            _KEYS, part=[int(part[r.start]) for r in runs], block=[_block_number(left, right)] * len(runs),
            payload=[_packed(content[r], doc[r]) for r in runs],
        )

    return send


def _under_smaller_ids(group: pa.Table) -> pa.Table:
    """For each block's message, whether each of its stretches stands in another block under a smaller id."""
    messages = [_unpacked(x, 2) for x in utf8(group["payload"])]
    content, doc = (np.concatenate(x) for x in zip(*messages, strict=True))
    order = np.lexsort((doc, content))
    first = np.flatnonzero(_changes(content[order]))
    later = np.empty(len(order), bool)
    later[order] = doc[order] > np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
    ends = np.cumsum([len(x) for x, _ in messages])
    return _answers(group, True, [np.packbits(x).tobytes() if x.any() else None for x in np.split(later, ends[:-1])])


def _merged(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans with those that overlap or touch made one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + size)[order]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(row * far + end)
    first = np.flatnonzero(np.concatenate([[True], (row * far + start)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - row[first] * far - start[first]


def _send_stretches(text: str, parts: int, bits: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {f.name: [] for f in _CUT}
        found = _candidates(left, right, text, parts, bits)
        if found is None:
            return _arrow(_CUT, **rows)
        part, content, doc, row, at, count, turn, place, data = found
        block = _block_number(left, right)

        def add(part: int, done: bool, meta: bytes, data: bytes) -> None:
            for name, x in zip(rows, (part, block, done, meta, data), strict=True):
                rows[name].append(x)

        distinct = _changes(part, content)
        number = np.cumsum(distinct) - 1
        first = np.flatnonzero(distinct)
        elsewhere = np.zeros(len(first), bool)
        answers = right.filter(pa.compute.equal(right["digests"], True))
        begin = {int(part[first[r.start]]): r for r in _runs(_changes(part[first]))}
        for p, payload in zip(answers["part"].to_pylist(), utf8(answers["payload"]), strict=True):
            own = elsewhere[begin[p]]
            own[:] = np.unpackbits(np.frombuffer(payload, np.uint8), count=len(own))
        later = elsewhere[number] | (doc > doc[first][number])  # an equal stretch stands under a smaller id
        if later.any():
            add(block % parts, True, _packed(*_merged(row[later], at[later], count[later] + WINDOW - 1)), b"")
        part, doc, row, at, count, turn, place = (x[~later] for x in (part, doc, row, at, count, turn, place))
        for r in _runs(_changes(part)):
            add(int(part[r.start]), False, _packed(doc[r], row[r], at[r], count[r], turn[r]), _gather(data, place[r], count[r] + WINDOW - 1).tobytes())
        return _arrow(_CUT, **rows)

    return send


def _sorted_spans(group: pa.Table) -> pa.Table:
    """Spans of windows that stand also under a smaller id, for each block."""
    out: dict[str, list] = {f.name: [] for f in _SPANS}

    def answer(block: int, payload: bytes) -> None:
        for name, x in zip(out, (block, None, None, payload), strict=True):
            out[name].append(x)

    blocks, done, meta, data = group["block"].to_pylist(), group["done"].to_pylist(), utf8(group["meta"]), utf8(group["data"])
    for i, b in enumerate(blocks):
        if done[i]:
            answer(b, meta[i])
    rest = [i for i in range(len(blocks)) if not done[i]]
    if rest:
        columns = [_unpacked(meta[i], 5) for i in rest]
        of = np.repeat(np.array([blocks[i] for i in rest]), [len(x[0]) for x in columns])
        doc, row, start, count, turn = (np.concatenate(x) for x in zip(*columns, strict=True))
        raw = np.frombuffer(b"".join(data[i] for i in rest), np.uint8)
        place = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
        turns = int(count.sum()) // SORT_ROWS + 1  # equal windows have equal hashes and so take the same turn
        turn = turn * turns >> 16
        for t in range(turns):
            own = np.flatnonzero(turn == t)
            if not len(own):
                continue
            n = count[own]
            size = n + WINDOW - 1
            words = big_endian_words(_gather(raw, place[own], size))
            stretch = np.repeat(np.arange(len(own)), n)
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            suffix = offset + np.repeat(np.cumsum(size) - size, n)
            order, fresh = sort_suffixes(words, suffix, WINDOW)
            head = np.flatnonzero(fresh)
            docs = doc[own][stretch[order]]
            low = np.repeat(np.minimum.reduceat(docs, head), np.diff(np.append(head, len(docs))))
            flag = np.zeros(len(order) + 2, np.int8)
            flag[order + 1] = docs > low
            flag = flag[1:-1]
            begin = np.flatnonzero((flag == 1) & ((np.concatenate([[0], flag[:-1]]) == 0) | (offset == 0)))
            end = np.flatnonzero((flag == 1) & ((np.concatenate([flag[1:], [0]]) == 0) | (offset == n[stretch] - 1)))
            s = own[stretch[begin]]
            by = np.argsort(of[s], kind="stable")
            begin, end, s = begin[by], end[by], s[by]
            for k in _runs(_changes(of[s])):
                answer(int(of[s[k.start]]), _packed(row[s[k]], start[s[k]] + offset[begin[k]], end[k] - begin[k] + WINDOW))
    return _arrow(_SPANS, **out)


def _removed(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` bytes is covered by a span."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, start + size, 1)
    return np.cumsum(edge[:-1]) > 0


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Characters of UTF-8 of which all bytes are removed."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(first) == len(raw) or not len(first) or first[0] != 0:
        return gone
    whole = np.logical_and.reduceat(gone, first)
    return np.repeat(whole, np.diff(np.append(first, len(raw))))


def _apply(schema: pa.Schema, text: str, text_col: str | None):
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, _, row, _, copy = _block(left, right, text)
        spans = [_unpacked(x, 3) for x in utf8(right["payload"]) if x]
        number, start, size = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else [np.empty(0, np.int64)] * 3
        order = np.argsort(number, kind="stable")
        number, start, size = number[order], start[order], size[order]
        begin, end = np.searchsorted(number, row), np.searchsorted(number, row, "right")
        kept, n_removed, n_spans = [], [], []
        for i, t in enumerate(texts):
            own = slice(begin[i], end[i])
            if copy[i] and len(t) >= WINDOW:
                kept.append(b"")
                n_removed.append(len(t))
                n_spans.append(1)
            elif own.start < own.stop:
                raw = np.frombuffer(t, np.uint8)
                gone = _removed(len(t), start[own], size[own])
                n_removed.append(int(gone.sum()))
                n_spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(raw[~(_whole_characters(raw, gone) if text_col else gone)].tobytes())
            else:
                kept.append(t)
                n_removed.append(0)
                n_spans.append(0)
        if text_col:
            changed = pa.array([n > 0 for n in n_removed])
            clean = pa.array([k.decode("utf-8", "replace") if n else None for k, n in zip(kept, n_removed, strict=True)], pa.string())
            columns = []
            for f in schema:
                c = left[f.name].combine_chunks()
                if f.name == text_col:
                    c = pa.compute.if_else(changed, clean, c.cast(pa.string()))
                columns.append(c.cast(f.type))
            return pa.Table.from_arrays(columns, schema=schema)
        return pa.Table.from_arrays(
            [
                left["__doc"].combine_chunks(), pa.array(list(map(len, texts)), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ],
            schema=schema,
        )

    return apply


@F.arrow_udf(T.BinaryType())
def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).digest() for t in utf8(texts)], pa.binary())


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, rows: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rid"),
            _sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.octet_length(F.col(text_col)).cast("long").alias("n"),
        ),
        "texts",
    )
    total = narrow.agg(F.sum("n")).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 8
    parts = min(n, RECEIVERS + n // PER_RECEIVER)
    bits = min(62, (total * 2 // (WINDOW - GRAM + 2)).bit_length() + SPARE_BITS)
    block = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(n)).cast("int")
    firsts = written(narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "firsts")
    copies = narrow.join(firsts, "digest").where("doc_id > first").select("doc_id", "rid").distinct()
    copies = written(copies.select(block.alias("block"), "doc_id", "rid", F.lit(None).cast("int").alias("part"), F.lit(None).cast("boolean").alias("digests"), F.lit(None).cast("binary").alias("payload")), "copies")
    discard(narrow, firsts)

    text = F.coalesce(F.col(text_col), F.lit(""))
    columns, name = [text.alias("__text")], "__text"
    if rows:
        columns = [F.col(c) for c in docs.columns]
        if isinstance(docs.schema[text_col].dataType, T.StringType):  # the text travels once
            name = text_col
        else:
            columns.append(text.alias(name))
    texts = docs.select(*columns, F.col(id_col).cast("long").alias("__doc"), F.xxhash64(text).alias("__rid"))
    texts = texts.withColumn("__block", F.pmod(F.xxhash64("__doc", "__rid"), F.lit(n)).cast("int"))
    by_block = texts.groupBy("__block")

    keys = by_block.cogroup(copies.groupBy("block")).applyInArrow(_send_keys(name, parts, bits), _KEYS)
    shared = copies.unionByName(keys.groupBy("part").applyInArrow(_shared_keys(HOT_BLOCKS), _SHARED))
    digests = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_digests(name, parts, bits), _KEYS)
    answers = shared.unionByName(digests.groupBy("part").applyInArrow(_under_smaller_ids, _SHARED))
    cut = by_block.cogroup(answers.groupBy("block")).applyInArrow(_send_stretches(name, parts, bits), _CUT)
    spans = cut.groupBy("part").applyInArrow(_sorted_spans, _SPANS)
    spans = spans.unionByName(copies.select("block", "doc_id", "rid", "payload"))
    if rows:
        schema = docs.schema
    else:
        schema = T.StructType().add("doc_id", T.LongType()).add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept_sha256", T.StringType())
    from pyspark.sql.pandas.types import to_arrow_schema

    return by_block.cogroup(spans.groupBy("block")).applyInArrow(_apply(to_arrow_schema(schema), name, text_col if rows else None), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated substrings cut out of the texts. A character of several bytes goes only as a whole."""
    return _deduplicated(docs, id_col, text_col, True)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses, and the digest of what is left."""
    return _deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", False)
