"""Byte-level BPE: encoding by merge ranks with a segment tree over byte positions, and decoding.

Every match of the split pattern is encoded by itself. A leaf of the tree stands for a byte position at which a token
starts and holds ``rank << bits | position`` of the pair that this token forms with the next one, so the root is the
leftmost pair of the smallest rank. A merge changes the leaves of the merged token, of the token before it and of the
token that is gone, and the nodes above these three: logarithmic work.

Short pieces, nearly all, are encoded many at a time: their trees are rows of one array, and one merge of each row is
one round of array operations. Longer pieces have a tree of their own.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import tidy

NONE = 1 << 30          # above any rank << 8 | position
BATCHED_BYTES = 256     # longer pieces are encoded one by one
MEMO = 75_000          # encodings a worker remembers, and as many older ones
MEMO_CHARS = 48         # longer strings are not remembered


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: each line a base64 token and its rank, which is also its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.width = max(self.token) + 1
        self.whole: dict[str, bytes] = {}       # ids, as int32, of pieces that are tokens
        for t, i in self.rank.items():
            with suppress(UnicodeDecodeError):
                self.whole[t.decode("utf-8")] = i.to_bytes(4, sys.byteorder)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        if self.width > 1 << 22:
            raise ValueError("ranks must fit 22 bits")
        pairs = {self.rank[t[:k]] * self.width + self.rank[t[k:]]: r for t, r in self.rank.items()
                 for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pairs = pairs
        # The pairs of single bytes, which every position of a piece begins with, are looked up at once.
        two = self.byte.astype(np.int64)[:, None] * self.width + self.byte
        self.byte_pairs = np.array([pairs.get(k, -1) for k in two.ravel().tolist()], np.int32)
        self.pieces, self.chunks = Memo(), Memo()

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens form, -1 where they form none."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    # -- one long piece ------------------------------------------------------------------------------------------

    def encode_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        size = 1 << max(n - 1, 1).bit_length()
        none = 1 << 62
        tokens = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nexts, befores = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        get, width = self.pairs.get, self.width

        def leaf(i: int) -> int:
            j = nexts[i]
            r = get(tokens[i] * width + tokens[j], -1) if j < n else -1
            return none if r < 0 else r * size + i

        tree[size:size + n] = [leaf(i) for i in range(n)]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value

        while tree[1] != none:
            r, i = divmod(tree[1], size)
            gone = nexts[i]
            tokens[i], nexts[i] = r, nexts[gone]
            if nexts[gone] < n:
                befores[nexts[gone]] = i
            update(gone, none)
            update(i, leaf(i))
            if befores[i] >= 0:
                update(befores[i], leaf(befores[i]))
        out, i = [], 0
        while i < n:
            out.append(tokens[i])
            i = nexts[i]
        return out

    # -- many short pieces ---------------------------------------------------------------------------------------

    def encode_batch(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as int32 of every piece. All pieces have at least 2 bytes and fit one tree size; row p of every array belongs to piece p."""
        lengths = np.array([len(p) for p in pieces])
        rows, n = len(pieces), int(lengths.max())
        size = 1 << max(n - 1, 1).bit_length()
        bits = size.bit_length() - 1
        columns = np.arange(n)
        inside = columns < lengths[:, None]
        nexts = np.broadcast_to(np.arange(1, n + 1, dtype=np.int32), (rows, n)).copy()
        befores = np.broadcast_to(np.arange(-1, n - 1, dtype=np.int32), (rows, n)).copy()
        tree = np.full((rows, 2 * size), NONE, np.int32)

        def leaves(row: np.ndarray, at: np.ndarray) -> np.ndarray:
            j = nexts[row, at]
            second = tokens[row, j]
            r = np.where(second < 0, -1, self.pair_rank(tokens[row, at], np.maximum(second, 0)))
            return np.where(r < 0, NONE, (r << bits) | at)

        data = np.zeros((rows, n + 1), np.int32)
        data[:, :n][inside] = np.frombuffer(b"".join(pieces), np.uint8)
        tokens = np.full((rows, n + 1), -1, np.int32)
        tokens[:, :n][inside] = self.byte[data[:, :n][inside]]
        r = self.byte_pairs[(data[:, :n] << 8) | data[:, 1:]]
        tree[:, size:size + n] = np.where((r < 0) | (tokens[:, 1:] < 0) | ~inside, NONE, (r << bits) | columns.astype(np.int32))
        level = size
        while level > 1:
            level >>= 1
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        live = inside.copy()
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            root = tree[row, 1]
            at, merged = root & (size - 1), root >> bits
            gone = nexts[row, at]
            after = nexts[row, gone]
            live[row, gone] = False
            tokens[row, at] = merged
            nexts[row, at] = after
            has = after < n
            befores[row[has], after[has]] = at[has]
            before = befores[row, at]
            before = np.where(before < 0, at, before)
            tree[row, size + gone] = NONE
            tree[row, size + at] = leaves(row, at)
            tree[row, size + before] = leaves(row, before)
            paths = np.stack([gone, at, before]) + size
            while paths[0, 0] > 1:
                paths >>= 1
                tree[row, paths] = np.minimum(tree[row, 2 * paths], tree[row, 2 * paths + 1])
            row = row[tree[row, 1] != NONE]
        flat = tokens[:, :n][live].tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids, as int32, of distinct pieces."""
        out = {p: self.whole[p] for p in self.whole.keys() & pieces}
        groups: dict[int, list[str]] = {}
        for piece in pieces.difference(out):
            groups.setdefault((len(piece.encode("utf-8")) - 1).bit_length(), []).append(piece)
        for bits, group in groups.items():
            if 1 << bits > BATCHED_BYTES:
                out.update((p, np.array(self.encode_long(p.encode("utf-8")), np.int32).tobytes()) for p in group)
                continue
            step = max(1, 65_536 >> bits)       # the arrays of one call stay in the processor's cache
            for k in range(0, len(group), step):
                part = group[k:k + step]
                out.update(zip(part, self.encode_batch([p.encode("utf-8") for p in part]), strict=True))
        return out

    def encode_texts(self, texts: list[str], pattern: regex.Pattern) -> list[bytes]:
        """Ids, as int32, of whole texts. They leave no cyclic garbage, so its collector rests: it would walk all strings held again and again."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode_texts(texts, pattern)
        finally:
            if collects:
                gc.enable()

    def _encode_texts(self, texts: list[str], pattern: regex.Pattern) -> list[bytes]:
        """Ids, as int32, of whole texts.

        A space between two characters that are not white space always starts a match, so what lies between two such
        spaces is encoded once per distinct string. Texts with white space next to a space are split as a whole.
        """
        chunks = [t.split(" ") for t in texts]
        known = self.chunks.known(set(chain.from_iterable(own[1:] for own in chunks)))
        new = {c: pattern.findall(" " + c) for c in known.missing if c and c == c.strip()}
        crossed = known.missing - new.keys()
        whole = [i for i, own in enumerate(chunks) if own[0][-1:].isspace() and len(own) > 1 or not crossed.isdisjoint(own[1:])]
        split = {i: pattern.findall(texts[i]) for i in whole}
        heads = {i: pattern.findall(own[0]) for i, own in enumerate(chunks) if i not in split}
        pieces = self.pieces.known(set(chain.from_iterable(chain(new.values(), split.values(), heads.values()))))
        pieces.add(self.encode_pieces(pieces.missing))
        of = pieces.found.__getitem__
        known.add({c: of(own[0]) if len(own) == 1 else b"".join(map(of, own)) for c, own in new.items()})
        get = known.found.__getitem__
        return [b"".join(map(of, split[i])) if i in split else b"".join((*map(of, heads[i]), *map(get, own[1:])))
                for i, own in enumerate(chunks)]


@dataclass
class Known:
    """Encodings found for a set of strings, and the strings that have none yet."""

    memo: Memo
    found: dict[str, bytes]
    missing: set[str]

    def add(self, new: dict[str, bytes]) -> None:
        self.found.update(new)
        self.memo.young.update(new)
        for k in new:
            if len(k) > MEMO_CHARS:
                del self.memo.young[k]


class Memo:
    """A bounded memory of encodings: when it is full, what was used since the last time stays."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, strings: set[str]) -> Known:
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        rest = strings.difference(young)
        missing = rest.difference(old)
        young.update((s, old[s]) for s in rest - missing)
        hit = strings - missing
        return Known(self, dict(zip(hit, map(young.__getitem__, hit), strict=True)), missing)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


GROUP_CHARS = 1_000_000     # characters encoded together


def groups(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; a null text has no ids. Special tokens are ordinary text."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(path), regex.compile(pattern)
        for batch in batches:
            at = 0
            for texts in groups([t or "" for t in batch.column("text").to_pylist()]):
                ids = vocab.encode_texts(texts, split)
                ids = [np.frombuffer(i, np.int32) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                at += len(texts)

    return documents.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the ids. Null ids decode to no bytes."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            out = [vocab.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded binary")


def digest(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass over the texts."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(path), regex.compile(pattern)
        names = [str(i) for i in range(vocab.width)].__getitem__
        for batch in batches:
            n, hashes, decoded = [], [], []
            for texts in groups([t or "" for t in batch.column("text").to_pylist()]):
                for ids in vocab.encode_texts(texts, split):
                    ids = np.frombuffer(ids, np.int32).tolist()
                    n.append(len(ids))
                    hashes.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
