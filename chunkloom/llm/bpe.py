"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

A word's leaves hold the rank and place of each pair of neighbouring symbols, inner nodes the smaller child, so the
root is the leftmost pair of lowest rank. A merge changes three leaves (the merged pair, the one after it, the one before it)
and the nodes above them. That goes on until the root holds no mergeable pair. Words of similar length are
encoded in step, as rows of one array of trees; a few words alone, very long ones mostly, by trees of plain lists. Either way
a word of n bytes takes O(n log n), however long it is.

Words are what the tokenizer file's splitting rule gives, over the whole text. A worker keeps the ids of words
it has met, up to a bound of words and of bytes. The text of a special token becomes its id, as in the tokenizers library.

Defined results: null and empty texts have no ids and decode to the empty text; bytes that aren't UTF-8 are read as the
replacement character. Other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import bounded_batches, grouped_by_bytes, utf8

#: Words that a worker keeps, and their bytes.
KEEP_WORDS, KEEP_BYTES = 600_000, 32 << 20
#: Symbols of the words that are encoded in step.
IN_STEP = 1 << 19
#: So many words of similar length aren't worth a step on arrays for each merge.
FEW_WORDS = 16
_NONE = np.int64(1) << np.int64(60)

# The splitting rule of byte-level tokenizers. White space is that of Unicode, spelled out.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RULE = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def _rule(letters: str, numbers: str) -> str:
    return _RULE.replace("{L}", letters).replace("{N}", numbers).replace("{S}", _SPACE)


_ANY = regex.compile(_rule(r"\p{L}", r"\p{N}"))
# The same for texts of characters below U+0250, by plain character classes.
_LATIN = re.compile(_rule(r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"))
_OTHER = re.compile("[^\x00-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file: itself, or else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of a tokenizer file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.array([vocabulary[c] for c in byte_symbols()], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self._index(keys)
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes

    # ranks of pairs: a hash table with linear probing, looked up for whole arrays

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 18)).astype(np.int64)

    def _index(self, keys: np.ndarray) -> None:
        self.table = np.full(1 << 18, -1, np.int64)
        self.rank_at = np.zeros(1 << 18, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.table[slot] not in (-1, key):
                slot = (slot + 1) & 0x3FFFF
            if self.table[slot] == -1:
                self.table[slot], self.rank_at[slot] = key, rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``_NONE`` where they don't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.table[slot]
        out = np.where(found == keys, self.rank_at[slot], _NONE)
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & 0x3FFFF
            found = self.table[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.rank_at[slot[more[hit]]]
            more = more[~hit & (found != -1)]
        return out

    @functools.cached_property
    def _pairs(self) -> dict[int, int]:
        """Rank of each pair that merges."""
        used = np.flatnonzero(self.table != -1)
        return dict(zip(self.table[used].tolist(), self.rank_at[used].tolist(), strict=True))

    def _alone(self, word: bytes, leaves: int) -> bytes:
        """Ids of one word of at most ``leaves`` + 1 bytes."""
        n, none, rank_of, merged = len(word), int(_NONE), self._pairs, self.merged
        first = self.first[np.frombuffer(word, np.uint8)]
        ranks = self.ranks(first[:-1], first[1:])
        nodes = np.full(2 * leaves, _NONE, np.int64)
        nodes[leaves : leaves + n - 1] = np.where(ranks == _NONE, _NONE, ranks * leaves + np.arange(n - 1))
        level = leaves >> 1
        while level:
            nodes[level : 2 * level] = np.minimum(nodes[2 * level : 4 * level : 2], nodes[2 * level + 1 : 4 * level : 2])
            level >>= 1
        tree, symbol = nodes.tolist(), first.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, rank: int | None) -> None:
            node = leaves + at
            tree[node] = none if rank is None else rank * leaves + at
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] != none:
            rank, at = divmod(tree[1], leaves)
            gone, back = after[at], before[at]
            follow = after[gone]
            made = symbol[at] = int(merged[rank])
            symbol[gone] = -1
            after[at] = follow
            if gone < leaves:
                put(gone, None)
            if follow < n:
                before[follow] = at
            put(at, rank_of.get(made << 32 | symbol[follow]) if follow < n else None)
            if back >= 0:
                put(back, rank_of.get(symbol[back] << 32 | made))
        ids = np.array(symbol, np.int64)
        return ids[ids >= 0].astype("<u4").tobytes()

    def _in_step(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Ids of words of at most ``leaves`` + 1 bytes."""
        count, wide = len(words), leaves + 2
        size = np.array([len(w) for w in words])
        symbol = np.zeros((count, wide), np.int32)
        column = np.arange(wide)
        inside = column[None, :] < size[:, None]
        symbol[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(column + 1, (count, 1))
        before = np.tile(column - 1, (count, 1))
        alive = inside.copy()
        tree = np.full((count, 2 * leaves), _NONE, np.int64)
        row, at = np.nonzero(inside[:, 1 : leaves + 1])
        rank = self.ranks(symbol[row, at], symbol[row, at + 1])
        tree[row, leaves + at] = np.where(rank == _NONE, _NONE, rank * leaves + at)
        level = leaves >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        active = np.flatnonzero(tree[:, 1] != _NONE)
        while len(active):
            rank, at = np.divmod(tree[active, 1], leaves)
            gone = after[active, at]
            follow = after[active, gone]
            made = self.merged[rank]
            symbol[active, at] = made
            alive[active, gone] = False
            after[active, at] = follow
            before[active, np.minimum(follow, wide - 1)] = at
            back = before[active, at]
            last = follow >= size[active]
            rank = self.ranks(made, symbol[active, np.minimum(follow, wide - 1)])
            leaf_at = np.where(last | (rank == _NONE), _NONE, rank * leaves + at)
            rank = self.ranks(symbol[active, np.maximum(back, 0)], made)
            leaf_back = np.where(rank == _NONE, _NONE, rank * leaves + back)
            some = back >= 0
            tree[active, leaves + at] = leaf_at
            inner = gone < leaves
            tree[active[inner], leaves + gone[inner]] = _NONE
            tree[active[some], leaves + back[some]] = leaf_back[some]
            paths = [(leaves + at) >> 1, (leaves + np.minimum(gone, leaves - 1)) >> 1, (leaves + np.maximum(back, 0)) >> 1]
            level = leaves >> 1
            while level:
                for k, node in enumerate(paths):
                    tree[active, node] = np.minimum(tree[active, 2 * node], tree[active, 2 * node + 1])
                    paths[k] = node >> 1
                level >>= 1
            active = active[tree[active, 1] != _NONE]
        ids = symbol[alive].astype("<u4").tobytes()
        end = 4 * np.cumsum(alive.sum(axis=1))
        return [ids[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_leaves: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = int(self.first[w[0]]).to_bytes(4, "little")
            elif w:
                by_leaves.setdefault(1 << (len(w) - 2).bit_length() if len(w) > 2 else 1, []).append(i)
        for leaves, which in by_leaves.items():
            step = max(1, IN_STEP // leaves)
            for at in range(0, len(which), step):
                part = which[at : at + step]
                if len(part) <= FEW_WORDS:
                    for i in part:
                        out[i] = self._alone(words[i], leaves)
                    continue
                for i, ids in zip(part, self._in_step([words[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        return (_ANY if _OTHER.search(text) else _LATIN).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        pieces: list[tuple[bool, list]] = []
        met: set[str] = set()
        for text in texts:
            marked = bool(self.special_pattern and self.special_pattern.search(text))
            if marked:
                words: list[str | int] = []
                at = 0
                for m in self.special_pattern.finditer(text):
                    words += self.split(text[at : m.start()])
                    words.append(self.special[m[0]])
                    at = m.end()
                words += self.split(text[at:])
                met.update(w for w in words if isinstance(w, str))
            else:
                words = self.split(text)
                met.update(words)
            pieces.append((marked, words))
        new = list(met.difference(self.words))
        if len(self.words) + len(new) > KEEP_WORDS or self.kept_bytes > KEEP_BYTES:
            self.words.clear()
            self.kept_bytes = 0
            new = list(met)
        as_bytes = [w.encode("utf-8", "replace") for w in new]
        self.kept_bytes += sum(map(len, as_bytes))
        self.words.update(zip(new, self.encode_words(as_bytes), strict=True))
        ids = self.words.__getitem__
        return [
            b"".join([ids(w) if isinstance(w, str) else w.to_bytes(4, "little") for w in words]) if marked else b"".join(map(ids, words))
            for marked, words in pieces
        ]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        at = np.frombuffer(ids, "<u4")
        size = self.sizes[at]
        offset = np.repeat(self.begin[at] - (np.cumsum(size) - size), size)
        return self.flat[np.arange(len(offset)) + offset].tobytes()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(text: F.Column, path: str) -> F.Column:
    """Ids of each text as little-endian 32-bit integers in a binary value."""

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts, out = utf8(column), []
            for part in grouped_by_bytes(texts, 1 << 20):
                out += codec(path).encode([t.decode("utf-8", "replace") for t in texts[part]])
            yield pa.array(out, pa.binary())

    return run(text)


def decode_column(ids: F.Column, path: str) -> F.Column:
    """The text of each binary value of ids."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([codec(path).decode(x).decode("utf-8", "replace") for x in utf8(column)], pa.string())

    return run(ids)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids don't leave the worker that makes them."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = utf8(batch["text"])
            for part in grouped_by_bytes(texts, 1 << 20):
                ids = c.encode([t.decode("utf-8", "replace") for t in texts[part]])
                decoded = [c.decode(x).decode("utf-8", "replace").encode() for x in ids]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(part.start, len(ids)), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
