"""Token ids of whole texts with the ``tokenizers`` library, inside tasks.

Both vocabularies split a text before their merges, so a text cut where they
split anyway gives the same ids part by part -- and parts repeat.  A text is cut

* before a space, and before and after a line feed, whose neighbours are both
  visible (no piece reaches over a space but for the one that may lead it);
* between an ASCII letter or digit and ASCII punctuation.

Anything else stays inside a part, and a text with the string of an added token
in it is one part.  Each worker keeps the ids of the parts it
has met in sorted arrays (``STORE_PARTS`` at most; then it starts anew), looks
up the distinct parts of a slice by 64-bit hash, and asks the library for the
new ones, many at a time with a separator of known ids between them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .textops import LOWER, _span_hash, distinct, per_text, text_bytes

STORE_PARTS = 3_000_000
SLICE_BYTES = 4 << 20
_SEPARATOR = "\x1e"
_TOGETHER = 128          # parts in one call's text

# leads of two-byte letters (U+00C0-02FF, Greek, Cyrillic but for its combining
# marks) and of CJK ideographs: no spaces and no combining marks among them
_LEAD2 = np.zeros(256, bool)
_LEAD2[[*range(0xC3, 0xCC), 0xCE, 0xCF, 0xD0, 0xD1, 0xD3]] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[0xE4:0xEA] = True
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_VISIBLE = _ALNUM | _MARK
_KIND = np.where(_MARK, 3, np.where(np.arange(256) == 10, 2, np.where(np.arange(256) == 32, 1, 0))).astype(np.uint8)


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of the parts of all texts (parts cover the texts)."""
    n = len(data)
    head = np.zeros(n + 1, bool)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    kind = _KIND[data]
    gap = np.flatnonzero((kind == 1) | (kind == 2))
    gap = gap[(gap > 1) & (gap < n - 1)]
    gap = gap[~first[gap] & ~first[gap + 1]]                 # not a text's first or last byte
    after = data[gap + 1]
    gap = gap[_VISIBLE[after] | _LEAD2[after] | _LEAD3[after]]
    x, y, z = data[gap - 1], data[gap - 2], data[np.maximum(gap - 3, 0)]
    tail = (x & 0xC0) == 0x80
    gap = gap[_VISIBLE[x] | tail & (_LEAD2[y] | ((y & 0xC0) == 0x80) & _LEAD3[z])]
    head[gap] = True
    head[gap[kind[gap] == 2] + 1] = True
    mark = np.flatnonzero(kind == 3)
    mark = mark[mark > 0]
    head[mark[_ALNUM[data[mark - 1]]]] = True
    head |= first
    return np.flatnonzero(head[:n])


class PartEncoder:
    """Ids by the library, part by part; one per worker and vocabulary file."""

    _workers: dict[str, "PartEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = {t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        x, around, after = self._each(["x", f"x {_SEPARATOR} x", " x"])
        self.separator = around[len(x): len(around) - len(after)]
        self._forget()

    @classmethod
    def of(cls, path: str) -> "PartEncoder":
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def _forget(self) -> None:
        self.names, self.flat = np.zeros(0, np.uint64), np.zeros(0, self.dtype)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _together(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts that begin with a space: some at a time, cut at the separators."""
        groups = [parts[lo:lo + _TOGETHER] for lo in range(0, len(parts), _TOGETHER)]
        gap = f" {_SEPARATOR}"
        out: list[np.ndarray] = []
        width = len(self.separator)
        for group, ids in zip(groups, self._each([_SEPARATOR + gap.join(g) + gap for g in groups])):
            at = np.flatnonzero(ids == self.separator[-1])
            for k in range(1, width):                 # the first has no space before it and may be shorter
                at = at[(at < width) | (ids[at - k] == self.separator[-1 - k])]
            if len(at) == len(group) + 1:
                out += [ids[a:b] for a, b in zip(at[:-1] + 1, at[1:] + 1 - width)]
            else:
                out += self._each(group)
        return out

    def _learn(self, names: np.ndarray, parts: list[str]) -> None:
        spaced = [i for i, p in enumerate(parts) if p[0] == " " and _SEPARATOR not in p
                  and not any(a in p.lower().encode() for a in self.added)]
        others = sorted(set(range(len(parts))) - set(spaced))
        found: list[np.ndarray] = [None] * len(parts)  # type: ignore[list-item]
        for places, ids in ((spaced, self._together([parts[i] for i in spaced])),
                            (others, self._each([parts[i] for i in others]) if others else [])):
            for i, x in zip(places, ids):
                found[i] = x
        size = np.array([len(x) for x in found], np.int32)
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *found])
        at = np.searchsorted(self.names, names)
        self.names, self.first, self.size = (np.insert(x, at, y) for x, y in (
            (self.names, names), (self.first, first), (self.size, size)))

    def _known(self, names: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, names)
        return (at < len(self.names)) & (self.names[np.minimum(at, max(0, len(self.names) - 1))] == names) \
            if len(self.names) else np.zeros(len(names), bool)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; offsets of the texts in them)."""
        data, bounds = text_bytes(texts)
        start = cuts(data, bounds)
        lower = LOWER[data].tobytes()
        if any(a in lower for a in self.added):
            whole = [any(a in lower[x:y] for a in self.added) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            inside = np.repeat(whole, np.diff(np.searchsorted(start, bounds)))
            start = start[~inside | np.isin(start, bounds)]
        stop = np.append(start[1:], len(data)) if len(start) else start
        names, example, place = distinct(_span_hash(data, start, stop))
        if len(self.names) > STORE_PARTS:
            self._forget()
        new = np.flatnonzero(~self._known(names))
        if len(new):
            raw = data.tobytes()
            spans = zip(start[example[new]].tolist(), stop[example[new]].tolist())
            self._learn(names[new], [raw[a:b].decode() for a, b in spans])
        at = np.searchsorted(self.names, names)
        first, size = self.first[at][place], self.size[at][place].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        counts = per_text(size, np.searchsorted(start, bounds))
        stops = np.cumsum(counts)
        return (np.insert(ids, stops, end).astype(self.dtype),
                np.concatenate([[0], stops + np.arange(1, len(stops) + 1)]))
