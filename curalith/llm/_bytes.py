"""Vectorised text helpers for Python workers: word bounds, rolling hashes, shingles, Arrow slices."""

from __future__ import annotations

import ctypes
import functools
import sys
import types

import numpy as np
import pyarrow as pa

#: Parsed vocabularies and tables outlive a task in a reused worker; functions travel by value, so this must not be a global of theirs.
CACHE = "curalith_worker_cache"
U = np.uint64
R = 0x9E3779B97F4A7C15
R_INVERSE = pow(R, -1, 1 << 64)


def worker_cache() -> dict:
    return sys.modules.setdefault(CACHE, types.ModuleType(CACHE)).__dict__


def tidy(run):
    """A function over batches that gives freed memory back to the system when it ends: workers outlive tasks, and an
    executor's memory is shared between them and its JVM."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all (the splitmix finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i below n."""
    cache = worker_cache()
    if len(cache.get("powers", ((),))[0]) < n:
        n = 1 << max(16, (n - 1).bit_length())
        out = []
        for r in (R, R_INVERSE):
            p = np.full(n, U(r))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        cache["powers"] = tuple(out)
    return cache["powers"]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch of about ``most`` text bytes (one row at least)."""
    sizes = np.diff(text_offsets(batch.column(column)))
    edge = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(edge)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, kind)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows joined, and offsets of rows in them. Nulls must have been filled."""
    off = text_offsets(col).astype(np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word's number for each row."""
    n = len(data)
    inner = np.zeros(n + 1, bool)
    inner[off] = True  # rows begin anew
    space = SPACE[data]
    word = ~space
    starts, ends = word.copy(), word.copy()
    if n:
        starts[1:] &= space[:-1] | inner[1:n]
        ends[:-1] &= space[1:] | inner[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    forth, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * forth[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        h = n
        for w in words.tolist():
            h = (h * R + w) & 0xFFFFFFFFFFFFFFFF
        return mix(np.array([h], U) ^ U(0x5851F42D4C957F2D))
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h *= U(R)
        h += words[i : n - k + 1 + i]
    return mix(h)


def hashed_words(col: pa.Array, lower: bool = False) -> list[np.ndarray]:
    """For each row, the hashes of its words in order."""
    data, off = text_bytes(col)
    if lower:
        data = LOWER[data]
    starts, ends, first = word_bounds(data, off)
    h = span_hash(data, starts, ends)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]
