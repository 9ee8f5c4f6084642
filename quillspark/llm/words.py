"""Word hashing over Arrow string columns, vectorised on the UTF-8 bytes of many documents at once.

A word is a maximal run of characters other than space and U+0009 to U+000D. These are single
bytes that never occur inside a longer UTF-8 sequence, so words can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Words of a run of documents. doc[i]:doc[i + 1] are the words of document i."""

    hashes: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def tokenize(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data)
    word = ~_SPACE[data]
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < n)]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def documents(column: pa.Array, lower: bool = False, most_bytes: int = 1 << 21) -> Iterator[tuple[int, Words]]:
    """(index of the first document, words) for slices of about most_bytes, whole documents each."""
    data, offsets = string_buffers(column)
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), count)
        lo, hi = offsets[first], offsets[last]
        yield first, tokenize(data[lo:hi], offsets[first : last + 1] - lo, lower)
        first = last


def grams(words: Words, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the offsets of each document's. A document of one to
    n - 1 words has its whole sequence as the only one (or none)."""
    counts = np.diff(words.doc)
    per = np.maximum(counts - n + 1, 0)
    if whole_if_short:
        per = np.where((counts > 0) & (counts < n), 1, per)
    offsets = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=offsets[1:])
    total = len(words.hashes)
    rolled = np.zeros(max(total, 0), np.uint64)
    padded = np.concatenate([words.hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + padded[k : k + total]
    at = np.repeat(words.doc[:-1] - offsets[:-1], per) + np.arange(offsets[-1])
    out = mix(rolled[at] + np.uint64(n)) if len(at) else np.zeros(0, np.uint64)
    if whole_if_short:
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words.hashes[words.doc[i] : words.doc[i + 1]]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + w
                out[offsets[i]] = mix(np.array([h + np.uint64(counts[i])]))[0]
    return out, offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and their offsets."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, doc))
    values = values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept[offsets]
