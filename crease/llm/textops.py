"""Vectorised word splitting and hashing of Arrow string columns (used inside tasks).

A text is its UTF-8 bytes.  ``split`` cuts every text of a column into maximal
runs of bytes of one class (class 0 separates); a null text has no words.
Word and window hashes are polynomial (Rabin-Karp) hashes modulo 2**64 with an
odd base, finished by a 64-bit mixer; they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 17


def classes(separators: bytes, punctuation: bytes = b"") -> np.ndarray:
    """Byte classes: 0 for separators, 2 for ``punctuation``, 1 for all others."""
    table = np.ones(256, np.uint8)
    table[list(punctuation)] = 2
    table[list(separators)] = 0
    return table


WHITESPACE = b" \t\n\x0b\x0c\r"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
WORDS = classes(WHITESPACE)                             # runs of [^\x20\x09-\x0D]
LINES = classes(b"\n")
TOKENS = classes(WHITESPACE, PUNCTUATION)               # words, and runs of ASCII punctuation
BARE_WORDS = classes(WHITESPACE + PUNCTUATION)          # words without ASCII punctuation
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Split(NamedTuple):
    data: np.ndarray      # bytes of all texts, one after the other
    bounds: np.ndarray    # text i is data[bounds[i]:bounds[i + 1]]
    start: np.ndarray     # words' first bytes
    end: np.ndarray       # words' ends
    offsets: np.ndarray   # text i has the words offsets[i]:offsets[i + 1]
    hash: np.ndarray      # 64-bit hash of each word


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = [_powers(_BASE, 1), _powers(_INVERSE, 1)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _tables[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two xor-shift-multiply rounds)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, vals = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(vals, np.uint8) if vals is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def row_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (one row at least)."""
    _, bounds = text_bytes(texts)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def split(texts: pa.Array, table: np.ndarray = WORDS, lower: bool = False) -> Split:
    data, bounds = text_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    cls = table[data]
    start = cls != 0
    end = start.copy()
    if n:
        change = cls[1:] != cls[:-1]
        start[1:] &= change
        end[:-1] &= change
        first = bounds[:-1][bounds[:-1] < n]
        last = bounds[1:][bounds[1:] > 0] - 1
        start[first] = cls[first] != 0
        end[last] = cls[last] != 0
    start = np.flatnonzero(start)
    end = np.flatnonzero(end) + 1
    return Split(data, bounds, start, end, np.searchsorted(start, bounds), _span_hash(data, start, end))


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of sorted, disjoint byte spans, some at a time to stay in the cache."""
    out, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + HASH_BYTES, "right")))
        first, last = start[lo], end[hi - 1]
        power, inverse = _power_tables(last - first + 1)
        total = np.zeros(last - first + 1, np.uint64)
        part = data[first:last].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: last - first]
        np.cumsum(part, out=total[1:])
        a, b = start[lo:hi] - first, end[lo:hi] - first
        out[lo:hi] = (total[b] - total[a]) * inverse[a]
        lo = hi
    return mix(out)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, an index of each, each entry's place among them)."""
    order = np.argsort(h)
    ordered = h[order]
    head = np.ones(len(h), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(head) - 1
    return ordered[head], order[head], place


def windows(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``width`` words inside one text, by a
    rolling polynomial hash over the word hashes."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    at = np.arange(n - width + 1)
    at = at[at + width <= np.repeat(offsets[1:], np.diff(offsets))[: n - width + 1]]
    return at, mix((total[at + width] - total[at]) * inverse[at])


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words some window starting in ``at`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of word ``values`` by text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
