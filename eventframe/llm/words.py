"""Words and word shingles of many texts at once, as 64-bit hashes, straight from the bytes of an Arrow column.

Words are the stretches without space or \\t..\\r, with A-Z lower-cased. A word's hash is a polynomial of its bytes modulo
2^64, taken from running sums and mixed; a shingle's hash combines those of its words. A text with fewer words than a
shingle has its whole sequence as its only shingle; one without words has none.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18       # bytes hashed together
CHUNK_BYTES = 1_000_000     # bytes of text handled together; a longer text is handled alone
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_bounds(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, from the bytes that belong to words and the starts of the texts."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = starts[(starts > 0) & (starts < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of words, their bytes taken as ``values``. Bytes are taken in blocks, so memory does not grow with a text."""
    out = np.empty(len(begin), np.uint64)
    power, inverse = _powers(BLOCK_BYTES)
    a = 0
    while a < len(begin):
        b = int(np.searchsorted(end, begin[a] + BLOCK_BYTES, side="right"))
        if b <= a:          # one word beyond the size of a block
            word = (values[data[begin[a]:end[a]]] - np.uint64(1)).astype(np.uint8).tobytes()
            out[a] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            a += 1
            continue
        lo, hi = begin[a], end[b - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * power[:hi - lo], out=sums[1:])
        raw = (sums[end[a:b] - lo] - sums[begin[a:b] - lo]) * inverse[begin[a:b] - lo]
        out[a:b] = mix(raw ^ (end[a:b] - begin[a:b]).astype(np.uint64) * _STEP)
        a = b
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the bytes, and for every text (from its start on) the number of words before it."""
    begin, end = word_bounds(_WORD[data], starts)
    return hash_words(data, begin, end, _LOWER), np.searchsorted(begin, starts)


def _shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and the bounds of each text's."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    at = np.zeros(len(n) + 1, np.int64)
    at[1:] = ends
    if len(words) >= k:
        full = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            full = full * _STEP + words[j:len(words) - k + 1 + j]
        position = np.arange(len(full))
        owner = np.searchsorted(bounds, position, side="right") - 1
        good = position + k <= bounds[owner + 1]
        where = at[owner[good]] + position[good] - bounds[owner[good]]
        out[where] = mix(full[good] + np.uint64(k))
    for m in range(1, k):
        texts = np.flatnonzero(n == m)
        h = np.zeros(len(texts), np.uint64)
        for j in range(m):
            h = h * _STEP + words[bounds[texts] + j]
        out[at[texts]] = mix(h + np.uint64(m))
    return out, at


def shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text in order, repetitions included; null texts have none."""
    for part, starts in _chunks(texts):
        words, before = _word_hashes(part, starts[:-1])
        out, at = _shingle_hashes(words, np.append(before, len(words)), k)
        for s, e in zip(at[:-1], at[1:], strict=True):
            yield out[s:e]


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function on Arrow batches, that hands freed memory back when its task ends: Python workers live on between tasks."""
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of consecutive texts and the bounds of each text in them."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def hash_functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` universal hash functions (a * x + b) mod 2^64, of which the high bits count."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
