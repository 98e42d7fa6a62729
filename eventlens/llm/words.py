"""Words and shingles of whole Arrow text columns as 64-bit hashes, by numpy over the UTF-8 buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z became a-z. NULL counts as empty.
Temporary memory is bounded by ``BLOCK`` bytes of text (or by the longest single word).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_STEP = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                  0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK)
        _tables["up"] = _powers(_BASE, size)
        _tables["down"] = _powers(pow(_BASE, -1, 2**64), size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a batch in order: byte range in ``data``, hash, and for each row the first word (``first[i]:first[i + 1]``)."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the row borders in them; NULL as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, borders, data = column.buffers()
    at = np.frombuffer(borders, dtype=np.int64 if large else np.int32) if borders else np.zeros(1, np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def words_of(column: pa.Array, is_space: np.ndarray = IS_SPACE) -> Words:
    """Words of each row; ``is_space`` marks the 256 byte values that stand between words."""
    data, at = buffers(column)
    codes = np.where(is_space, np.uint64(0), _CODES[LOWER])
    inner = ~is_space[data]
    opens, closes = inner.copy(), inner.copy()
    opens[1:] &= ~inner[:-1]
    closes[:-1] &= ~inner[1:]
    edge = at[(at > 0) & (at < len(data))]
    opens[edge] = inner[edge]
    closes[edge - 1] = inner[edge - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(begin), dtype=np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + BLOCK, "right")))
        lo, hi = begin[a], end[b - 1]
        up, down = _power_tables(hi - lo)
        values = codes[data[lo:hi]] * up[: hi - lo]
        local = begin[a:b] - lo
        hashes[a:b] = mix(np.add.reduceat(values, local) * down[local])
        a = b
    return Words(data, begin, end, hashes, np.searchsorted(begin, at))


def shingles_of(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows in order, and the borders of each row in them.

    A row with 1 to k - 1 words gives its whole sequence as one shingle if ``short``, else nothing.
    """
    n = np.diff(words.first)
    full = max(len(words.hash) - k + 1, 0)
    rolled = np.zeros(full, dtype=np.uint64)
    for j in range(k):
        rolled += words.hash[j : j + full] * _STEP[j % len(_STEP)] * np.uint64(2 * (j // len(_STEP)) + 1)
    rolled = mix(rolled)
    count = np.where(n >= k, n - k + 1, (n > 0) & short)
    at = np.concatenate([[0], np.cumsum(count)])
    keep = np.repeat(words.first[:-1], count) + (np.arange(at[-1]) - np.repeat(at[:-1], count))
    if not short or not (count[n < k] > 0).any():
        return rolled[keep], at
    out = np.empty(at[-1], dtype=np.uint64)
    long = np.repeat(n >= k, count)
    out[long] = rolled[keep[long]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        some = words.hash[words.first[i] : words.first[i + 1]]
        out[at[i]] = mix(np.add.reduce(np.append(some * _STEP[: n[i]], np.uint64(n[i])), keepdims=True))[0]
    return out, at


def short_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, equal to the one that ``shingles_of`` gives a row of just these words for a greater k."""
    n = np.diff(words.first)
    full = max(len(words.hash) - size + 1, 0)
    rolled = np.full(full, size, dtype=np.uint64)
    for j in range(size):
        rolled += words.hash[j : j + full] * _STEP[j]
    count = np.maximum(n - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    keep = np.repeat(words.first[:-1], count) + (np.arange(at[-1]) - np.repeat(at[:-1], count))
    return mix(rolled)[keep], at


def sets_of(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    hashes, at = shingles_of(words_of(column), k)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.unique(hashes[a:b])
